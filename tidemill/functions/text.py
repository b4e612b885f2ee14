"""Text, date and scoring functions. All are native columns; as_of stands for the time of the run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]"
SENTENCE_ENDS = r"[.!?\x{3002}\x{FF01}\x{FF1F}\x{061F}\x{0964}\x{2026}]+"
WORD = r"[\p{L}\p{N}_]+"


def is_cjk(text: Column) -> Column:
    """More than a fifth of the first 200 characters."""
    head = F.substring(text, 1, 200)
    return F.coalesce(F.regexp_count(head, F.lit(CJK)) > F.length(head) * 0.2, F.lit(False))


def sentence_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SENTENCE_ENDS), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != ""))


def _once(value: Column, use) -> Column:
    """use(value), value worked out once however often use names it: the array of one binds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def uniqueness(text: Column) -> Column:
    """Distinct among the first 400 words, from 0.25 (0) to 0.65 (1); 0 for less than 20 words."""

    def score(words):
        n = F.size(words)
        ratio = (F.size(F.array_distinct(words)) / F.greatest(n, F.lit(1)) - 0.25) / 0.40
        return F.when(n < 20, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(ratio, F.lit(1.0))))

    return _once(F.slice(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), 1, 400), score)


def _iso_week(text: Column) -> Column:
    """YYYY-Www-D, with or without hyphens: the week of January 4th is the first."""
    part = lambda k: F.nullif(F.regexp_extract(text, r"^([0-9]{4})-?W([0-4][0-9]|5[0-3])(?:-?([1-7]))?$", k), F.lit("")).cast("int")
    fourth = F.make_date(part(1), F.lit(1), F.lit(4))
    return F.date_add(F.date_sub(fourth, F.weekday(fourth)), (part(2) - 1) * 7 + F.coalesce(part(3), F.lit(1)) - 1).cast("timestamp")


def parse_date(text: Column) -> Column:
    """The first form that fits: date and time, date, date with slashes, then the other ISO forms, a zone counting only there."""
    ts = lambda x, f: F.try_to_timestamp(x, F.lit(f))
    rest = F.when(text.rlike("^[0-9]{8}"), F.coalesce(*(ts(text, f) for f in ("yyyyMMdd", "yyyyMMdd'T'HHmm[ss][XXX][XX]", "yyyyMMdd'T'HH:mm[:ss][XXX]"))))
    return F.coalesce(ts(F.substring(text, 1, 19), "yyyy-M-d'T'H:m:s"), ts(F.substring(text, 1, 10), "yyyy-M-d"), ts(F.substring(text, 1, 10), "yyyy/M/d"), rest, _iso_week(text))


def freshness(publish_date: Column, as_of: Column) -> Column:
    """1 up to 7 days and for future dates, falling to 0 at 365; 0 without a date."""
    age = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(parse_date(publish_date))) / 86400)
    return F.when(age.isNull(), 0.0).when(age <= 7, 1.0).when(age >= 365, 0.0).otherwise(1.0 - (age - 7) / 358.0)


def quality(text: Column, title: Column, author: Column, publish_date: Column, headings: Column, language: Column, as_of: Column) -> Column:
    """struct(score, reasons): nine rounded parts, their sum capped at 1."""
    some = lambda c, w: F.when(F.coalesce(c, F.lit("")) != "", w).otherwise(0.0)
    body, cjk = F.coalesce(text, F.lit("")), is_cjk(F.coalesce(text, F.lit("")))
    parts = {
        "text_length": F.round(F.least(F.length(body) / F.when(cjk, 1000).otherwise(3000), F.lit(1.0)) * 0.25, 3),
        "has_title": some(title, 0.10),
        "has_author": some(author, 0.10),
        "has_date": some(publish_date, 0.05),
        "headings": F.round(F.least(F.coalesce(F.size(headings), F.lit(0)) / 3, F.lit(1.0)) * 0.10, 3),
        "language_detected": some(language, 0.10),
        "sentence_count": F.round(F.least(sentence_count(body) / F.when(cjk, 5).otherwise(10), F.lit(1.0)) * 0.10, 3),
        "freshness": F.round(freshness(publish_date, as_of) * 0.10, 3),
        "uniqueness": F.round(uniqueness(body) * 0.10, 3),
    }
    total = sum(parts.values(), F.lit(0.0))
    reasons = F.create_map(*(x for k, v in parts.items() for x in (F.lit(k), v)))
    return F.struct(F.round(F.least(total, F.lit(1.0)), 3).alias("score"), reasons.alias("reasons"))


def norm_title(title: Column) -> Column:
    bare = F.regexp_replace(title, r"^(.*) \| .*$", "$1")
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
    return F.nullif(clean, F.lit(""))


def norm_date(date: Column) -> Column:
    return F.nullif(F.coalesce(F.nullif(F.regexp_extract(date, "^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("")), F.substring(date, 1, 10)), F.lit(""))


def shingles(text: Column) -> Column:
    """Three-word windows, or three-character windows where the first 200 characters hold any CJK; shorter texts are one."""
    low = F.lower(text)
    words = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    chars = F.regexp_replace(low, r"\s+", "")
    by_word = _once(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - 2)), lambda i: F.array_join(F.slice(w, i, 3), " ")))
    by_char = _once(chars, lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - 2)), lambda i: F.substring(c, i, F.lit(3))))
    return F.when(F.substring(low, 1, 200).rlike(CJK), by_char).otherwise(by_word)


def translate_chunks(text: Column, language: Column, cap: int = 20_000, size: int = 4_500) -> Column:
    """Parts of the first `cap` characters for a translator; null for English and for empty texts."""
    head = F.substring(text, 1, cap)
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(head) / size).cast("int") - 1)), lambda i: F.substring(head, i * size + 1, F.lit(size)))
    return F.when(~is_english(language) & (F.length(head) > 0), parts)


# Some function words of the languages that detection tells apart.
STOP = {
    "en": "the and of to in is that it for with".split(),
    "de": "der die und das ist nicht ein mit den von".split(),
    "fr": "le la les et des est une dans que pour".split(),
    "es": "el los las que por una con para del se".split(),
}


def detect_language(text: Column) -> Column:
    """Language with most function words, null for under 50 characters (15 with CJK) or none; ties go by the alphabet."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    among = lambda w, s: F.size(F.filter(w, lambda x: x.isin(s)))
    votes = lambda w: F.array_max(F.array(*(F.struct(among(w, s).alias("n"), F.lit(-k).alias("k"), F.lit(c).alias("lang")) for k, (c, s) in enumerate(sorted(STOP.items())))))
    enough = F.length(text) >= F.when(F.substring(text, 1, 100).rlike(CJK), 15).otherwise(50)
    return F.when(enough, _once(_once(words, votes), lambda best: F.when(best["n"] > 0, best["lang"])))


def repair(text: Column) -> Column:
    """Encoding repair: UTF-8 read as Latin-1 where that round trip is sound for the whole text, curly quotes, ligatures, control characters."""
    sure = text.rlike("[\u00c2-\u00f4][\u0080-\u00bf]") & ~text.rlike("[^\x00-\u00ff]")
    back = F.try_validate_utf8(F.encode(F.when(sure, text), "ISO-8859-1").cast("string"))
    fixed = F.translate(F.coalesce(back, text), "‘’“”", "''\"\"")
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff")):
        fixed = F.replace(fixed, F.lit(a), F.lit(b))
    return F.regexp_replace(fixed, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def join_translated(parts: Column) -> Column:
    """A text of its translated chunks: empty ones left out, a space between, null for nothing."""
    return F.nullif(F.trim(F.array_join(F.filter(parts, lambda p: p != ""), " ")), F.lit(""))


def is_english(language: Column) -> Column:
    return F.lower(F.coalesce(language, F.lit(""))).startswith("en")
