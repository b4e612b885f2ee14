"""Detection of pages that a site serves in place of its content."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Refusals, by language.
BLOCK_PHRASES = (
    "access denied", "you have been blocked", "are you a robot", "verify you are human", "request blocked",
    "acceso denegado", "has sido bloqueado", "verifica que eres humano",
    "accès refusé", "acces refuse", "vous avez été bloqué", "vérifiez que vous êtes humain",
    "zugriff verweigert", "sie wurden blockiert", "bestätigen sie, dass sie ein mensch",
    "acesso negado", "você foi bloqueado", "verifique se você é humano",
    "accesso negato", "sei stato bloccato", "verifica di essere umano",
    "访问被拒绝", "アクセスが拒否されました", "접근이 거부되었습니다", "تم رفض الوصول",
)
# Browser checks, by language.
CHALLENGE_PHRASES = (
    "just a moment", "checking your browser", "enable javascript", "un momento", "vérification de votre navigateur",
    "ihr browser wird überprüft", "verificando seu navegador", "controllo del browser",
)
# Walls against automated traffic, by language.
WALL_PHRASES = (
    "your traffic has been identified as automated", "traffic has been identified as automated", "unusual traffic",
    "automated traffic", "detected unusual activity", "suspicious activity has been detected", "bot detected",
    "to continue, please verify", "please verify you are a human",
    "votre trafic a été identifié comme automatisé", "trafic a été identifié comme automatisé", "trafic automatisé", "activité suspecte",
    "tráfico automatizado", "actividad inusual", "actividad sospechosa",
    "automatisierter datenverkehr", "ungewöhnlicher datenverkehr",
    "tráfego automatizado", "atividade incomum", "traffico automatizzato", "attività insolita",
)
CAPTCHA = "recaptcha|hcaptcha|captcha-container"


def any_of(phrases: tuple[str, ...]) -> str:
    return "|".join(map(re.escape, phrases))


def detect_block(status: Column, html: Column, headers: Column | None = None) -> Column:
    """struct(blocked, reason), the first rule that holds; a null body counts as empty. Long pages are only blocked by walls."""
    low = F.lower(F.coalesce(html, F.lit("")))
    n = F.length(F.regexp_replace(F.coalesce(html, F.lit("")), r"^\s+|\s+$", ""))
    ray = F.coalesce(F.map_contains_key(headers, "cf-ray"), F.lit(False)) if headers is not None else F.lit(False)
    short = n < 2000
    why = (
        F.when(status == 429, "rate_limited_429").when(status == 403, "forbidden_403").when(status == 503, "service_unavailable_503")
        .when(low.rlike(any_of(WALL_PHRASES)), "bot_wall")
        .when(short & ray & low.rlike(any_of(CHALLENGE_PHRASES)), "cloudflare_challenge")
        .when(short & low.rlike(CAPTCHA), "captcha")
        .when(short & low.rlike(any_of(BLOCK_PHRASES)), "access_denied")
        .when((status == 200) & (n < 300), "suspicious_empty_body")
    )
    return F.struct(why.isNotNull().alias("blocked"), why.alias("reason"))


def detect_block_legacy(status: Column, html: Column, headers: Column | None = None) -> Column:
    """The older engine's rules: no walls, and phrases count at any length."""
    low = F.lower(F.coalesce(html, F.lit("")))
    ray = F.coalesce(F.map_contains_key(headers, "cf-ray"), F.lit(False)) if headers is not None else F.lit(False)
    why = (
        F.when(status.isin(403, 429, 503), F.concat(F.lit("http_"), status.cast("string")))
        .when(ray & low.rlike(any_of(CHALLENGE_PHRASES)), "cloudflare_challenge")
        .when(low.rlike("recaptcha|hcaptcha"), "captcha")
        .when(low.rlike(any_of(BLOCK_PHRASES)), "access_denied")
        .when((status == 200) & (F.length(F.coalesce(html, F.lit(""))) < 300), "suspicious_empty")
    )
    return F.struct(why.isNotNull().alias("blocked"), why.alias("reason"))
