"""URL functions: dedup key, page type, traps, priorities. All are native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track.
STRIP_PARAMS = """utm_source utm_medium utm_campaign utm_term utm_content fbclid gclid gclsrc dclid msclkid ref ref_src
source via mc_cid mc_eid _ga yclid igshid spm cmpid campaign outputtype""".split()
# Path segments of alternate renderings.
ALT_SEGMENTS = ["amp", "mobile", "m", "print", "printable"]
# Path words of pages that are no articles, by language.
JUNK_WORDS = """tag tags category categories author authors search find login signin register signup subscribe feed rss
sitemap cart checkout account profile comment comments reply replies archive archives page pagination print amp mobile
embed share widget banner ad ads popup
etiqueta etiquetas categoria categorias autor autores buscar busqueda acceder registrarse suscribirse comentario
comentarios archivo pagina carro
etiquette categorie auteur auteurs recherche connexion inscription abonnement commentaire commentaires imprimer panier
schlagwort kategorie kategorien suche anmelden registrieren abonnieren kommentar kommentare archiv seite drucken warenkorb
busca pesquisa entrar cadastro assinar arquivo carrinho
categorie autore autori cerca ricerca accedi registrati abbonati commento commenti stampa carrello""".split()
# Path words of articles, by language.
HINT_WORDS = """article articles news post posts blog story stories wiki docs documentation guide guides report analysis
opinion editorial feature explainer review reviews
articulo articulos noticia noticias entrada reportaje analisis cronica reportajes
actualite actualites actu nouvelle nouvelles billet reportage analyse chronique dossier
artikel nachricht nachrichten beitrag meldung bericht kolumne
artigo artigos materia reportagem analise
articolo articoli notizia notizie cronaca analisi approfondimento
kiji shimbun akhbar maqal maqala""".split()
# Query keys of listings.
JUNK_PARAMS = "s q query search sort order filter replytocom buscar busqueda recherche suche pesquisa ricerca".split()
# Pagination and calendar patterns, and scripts other than Latin.
PAGINATION = r"(?i)(/page/[0-9]+|/p/[0-9]+|/pagina/[0-9]+|/seite/[0-9]+|\?page=[0-9]+|\?pagina=[0-9]+|\?seite=[0-9]+|\?offset=[0-9]+|\?start=[0-9]+|/[0-9]+/$)"
CALENDAR = r"/[0-9]{4}/[0-9]{2}/?$"
NON_LATIN = r"[\x{0400}-\x{04FF}\x{0590}-\x{05FF}\x{0600}-\x{06FF}\x{0900}-\x{097F}\x{0E00}-\x{0E7F}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]"

JUNK = "/(" + "|".join(dict.fromkeys(JUNK_WORDS)) + ")s?(/|$)"
HINT = "/(" + "|".join(dict.fromkeys(HINT_WORDS)) + ")(/|$|-)"
ANY_PATH = r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)(?:\?([^#]*))?"
SPLIT = r"^([^:/?#]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def netloc(url: Column) -> Column:
    """Host with port and user as written."""
    return F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)


def raw_path(url: Column) -> Column:
    return F.regexp_extract(url, SPLIT, 3)


def raw_query(url: Column) -> Column:
    return F.regexp_extract(url, SPLIT, 4)


def unquote(part: Column) -> Column:
    """Percent-decoding that leaves plus signs, and text that can't be decoded, alone."""
    return F.coalesce(F.try_url_decode(F.replace(part, F.lit("+"), F.lit("%2B"))), part)


def query_pairs(query: Column) -> Column:
    """Array of (k, v), decoded; parameters without a value are left out."""
    parts = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]*=.+$"))
    dec = lambda x: F.coalesce(F.try_url_decode(x), x)
    return F.transform(parts, lambda p: F.struct(dec(F.substring_index(p, "=", 1)).alias("k"), dec(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))


def _encode(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def strip_alt_segments(path: Column) -> Column:
    kept = F.filter(F.split(path, "/"), lambda s: (s != "") & ~F.lower(s).isin(ALT_SEGMENTS))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def normalize_url(url: Column) -> Column:
    """Dedup key of a url; null and blank urls have the empty key."""
    u = F.trim(F.coalesce(url, F.lit("")))
    u = F.when(F.instr(u, "://") > 0, u).otherwise(F.concat(F.lit("https://"), u))
    host_port = F.regexp_replace(netloc(u), "^.*@", "")
    # An address in brackets has colons of its own.
    host = F.regexp_replace(F.lower(F.regexp_extract(host_port, r"^(?:\[([^\]]*)\]?)", 1)), "^$", F.regexp_replace(F.lower(F.regexp_extract(host_port, r"^([^:\[]*)", 1)), r"^www\.", ""))
    port = F.regexp_extract(host_port, r"^(?:\[[^\]]*\]|[^:]*):0*([0-9]+)$", 1)
    port = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    pairs = F.array_sort(F.filter(query_pairs(F.regexp_extract(u, ANY_PATH, 2)), lambda p: ~F.lower(p["k"]).isin(STRIP_PARAMS)))
    query = F.array_join(F.transform(pairs, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")
    key = F.concat(F.lit("https://"), host, port, strip_alt_segments(F.regexp_extract(u, ANY_PATH, 1)), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(F.trim(F.coalesce(url, F.lit(""))) == "", "").otherwise(key)


def has_article_slug(path: Column) -> Column:
    slug = unquote(F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1))
    return F.when(slug.rlike(NON_LATIN), F.length(slug) >= 2).otherwise(slug.rlike("(?i)[a-z]{3,}") & (F.length(slug) > 5))


def classify_url(url: Column) -> Column:
    """struct(page_type, reason); the order of the tests is part of it."""
    path = F.lower(unquote(raw_path(url)))
    junk = F.array_sort(F.array_intersect(F.transform(query_pairs(raw_query(url)), lambda p: p["k"]), F.array(*map(F.lit, JUNK_PARAMS))))
    out = lambda kind, why: F.struct(F.lit(kind).alias("page_type"), why.alias("reason"))
    return (
        F.when(path.rlike(JUNK), out("skip", F.lit("junk_path_segment")))
        .when(url.rlike(PAGINATION), out("skip", F.lit("pagination")))
        .when(path.rlike(CALENDAR), out("skip", F.lit("calendar_trap")))
        .when(F.size(junk) > 0, out("skip", F.concat(F.lit("junk_query_param:"), F.array_join(junk, ","))))
        .when(path.rlike(HINT), out("article", F.lit("article_path_hint")))
        .when(has_article_slug(path), out("article", F.lit("article_slug")))
        .otherwise(out("skip", F.lit("no_article_signal")))
    )


def is_trap(url: Column) -> Column:
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    return (count(raw_path(url), "/") > 8) | (count(raw_query(url), "&") >= 3)


def is_sitemap(url: Column) -> Column:
    return F.contains(F.lower(raw_path(url)), F.lit("sitemap"))


def sitemap_priority(url: Column) -> Column:
    low = F.lower(url)
    return (
        F.when(low.rlike("/feed|/rss|atom|rss2"), 0).when(F.contains(low, F.lit("news")) & F.contains(low, F.lit("sitemap")), 1)
        .when(F.contains(low, F.lit("sitemap_index")) | low.rlike("/sitemap[.]xml/*$"), 3).otherwise(2)
    )


def retry_backoff(attempts: Column) -> Column:
    """Seconds to wait before attempt number attempts + 1; doubled thirty times at most, some thousand years."""
    return F.lit(30).cast("long") * F.pow(F.lit(2), F.when(attempts > 30, 30).otherwise(attempts)).cast("long")


def domain_list(text: Column) -> Column:
    """Comma-separated domains, trimmed, without empties and without a literal scheme."""
    names = F.transform(F.split(text, ","), lambda d: F.regexp_replace(F.trim(d), "^https?://", ""))
    return F.filter(names, lambda d: d != "")
