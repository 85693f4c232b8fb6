"""Text functions as Spark columns: n-grams, words, identifier normalisation, key packing, impacts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English function words that are dropped after lower-casing; pass another list for other languages.
ENGLISH = tuple("a an and are as at be but by for from had has have he in is it its of on or that the this to was were which will with".split())


def gram_words(text: Column, case_sensitive: bool = False) -> Column:
    """White-space words with everything but letters and decimal digits removed, in lower case unless told otherwise."""
    plain = F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{Nd}]", ""))
    return plain if case_sensitive else F.transform(plain, F.lower)


def ngrams(text: Column, n: int = 3, case_sensitive: bool = False) -> Column:
    """The distinct n-character windows of each word; shorter words have none."""
    long = F.filter(gram_words(text, case_sensitive), lambda w: F.length(w) >= n)
    return F.array_distinct(F.flatten(F.transform(long, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - (n - 1)), lambda i: F.substring(w, i, F.lit(n))))))


def words(text: Column, case_sensitive: bool = False) -> Column:
    """Maximal runs of alphabetic or numeric characters."""
    return F.regexp_extract_all(text if case_sensitive else F.lower(text), F.lit(r"([\p{IsAlphabetic}\p{N}]+)"), 1)


def without_stop_words(tokens: Column, stop: tuple[str, ...] = ENGLISH) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*stop))


def normalize_id(value: Column) -> Column:
    """ASCII letters and digits only, in upper case."""
    return F.upper(F.regexp_replace(value, "[^0-9A-Za-z]", ""))


def fnv1a(data: Column, basis: int = 0xCBF29CE484222325) -> Column:
    """64-bit FNV-1a of a binary column. The prime is 2^40 + 435, so two 32-bit halves never overflow."""
    signed = basis - (1 << 64) if basis >> 63 else basis
    mask = F.lit(0xFFFFFFFF)

    def step(h: Column, b: Column) -> Column:
        h = h.bitwiseXOR(b)
        lo, hi = h.bitwiseAND(mask), F.shiftrightunsigned(h, 32)
        t0 = lo * 435
        t1 = hi * 435 + F.shiftrightunsigned(t0, 32) + F.shiftleft(lo, 8).bitwiseAND(mask)
        return F.shiftleft(t1.bitwiseAND(mask), 32).bitwiseOR(t0.bitwiseAND(mask))

    hexed = F.hex(data)
    codes = F.when(F.length(hexed) > 0, F.transform(F.sequence(F.lit(1), F.length(hexed), F.lit(2)), lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(codes, F.lit(signed).cast("long"), step)


def gram_key(gram: Column, n: int = 3) -> Column:
    """An n-gram as a number: 32 bits a character up to two, 8 bits up to eight ASCII ones, else FNV-1a over UTF-32."""
    chars = F.split(gram, "")
    chars = F.filter(chars, lambda c: c != "")
    points = F.transform(chars, lambda c: F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long"))
    zero = F.lit(0).cast("long")
    if n <= 2:
        return F.aggregate(points, zero, lambda k, c: F.shiftleft(k, 32).bitwiseOR(c))
    little = F.unhex(F.concat_ws("", F.transform(points, lambda c: F.concat(*[F.lpad(F.hex(F.shiftright(c, s).bitwiseAND(F.lit(255))), 2, "0") for s in (0, 8, 16, 24)]))))
    hashed = fnv1a(little)
    return F.when(F.lit(n <= 8) & F.forall(points, lambda c: c < 128), F.aggregate(points, zero, lambda k, c: F.shiftleft(k, 8).bitwiseOR(c))).otherwise(hashed)


def quantize_impact(tf: Column, dl: Column, avgdl: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """A term's BM25 saturation in a document as an integer from 1 to 255."""
    tf = tf.cast("double")
    raw = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)) * 255.0 / (k1 + 1)
    return F.least(F.lit(255), F.greatest(F.lit(1), F.floor(raw + 0.5).cast("int")))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def facet_key(field: Column, category: Column, case_sensitive: bool = False) -> Column:
    """A 64-bit name of a category for presence tests: FNV-1a over field, unit separator and category."""
    f, c = (field, category) if case_sensitive else (F.lower(field), F.lower(category))
    return fnv1a(F.concat(f, F.lit("\x1f"), c).cast("binary"))


#: Languages by number from 1, with their ISO 639-1 codes.
LANGUAGES = {"english": "en", "spanish": "es", "arabic": "ar", "danish": "da", "dutch": "nl", "finnish": "fi", "french": "fr", "german": "de", "greek": "el", "hungarian": "hu", "italian": "it", "norwegian": "no", "portuguese": "pt", "romanian": "ro", "russian": "ru", "swedish": "sv", "tamil": "ta", "turkish": "tr"}


def language(code: str) -> tuple[int, str]:
    """(number, name) of a language's name or ISO 639-1 code in any case."""
    c = code.strip().lower()
    for i, (name, iso) in enumerate(LANGUAGES.items(), 1):
        if c in (name, iso):
            return i, name
    raise ValueError(f"unknown language {code!r}")

