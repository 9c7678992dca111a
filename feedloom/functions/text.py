"""Text functions as Column builders.  White space is Unicode white space; word edges are ASCII."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that carry no meaning in titles.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "for", "from", "has", "have", "in", "into", "is", "it", "its", "of", "on", "or", "that",
    "the", "their", "they", "this", "to", "was", "were", "which", "with", "we", "our", "using", "used", "can", "may", "these", "those", "than", "then",
]
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
BLOCKS = r"(?iU)<\s*/?\s*(p|div|li|ul|ol|tr|td|th|h[1-6]|section|article|header|footer|blockquote)(?![A-Za-z0-9_])[^>]*>"
# The character names that are known; others stay as they are.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "hellip": "…", "middot": "·", "bull": "•", "deg": "°", "times": "×", "minus": "−", "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "omega": "ω",
    "micro": "µ", "plusmn": "±", "le": "≤", "ge": "≥", "ne": "≠", "reg": "®", "copy": "©", "trade": "™",
}


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row, however often the body uses it and wherever a filter is pushed."""
    return F.element_at(F.transform(F.array(value), body), 1)


# The character names that study listings use.
STUDY_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "hellip": "…", "bull": "•", "middot": "·", "deg": "°", "cent": "¢", "pound": "£", "euro": "€", "trade": "™", "copy": "©", "reg": "®", "frac12": "½", "frac14": "¼", "frac34": "¾",
    "times": "×", "minus": "−", "plusmn": "±", "eacute": "é", "szlig": "ß",
}
STUDY_BLOCKS = r"(?iU)<\s*/?\s*(?:br|p|div|li|ul|ol|tr|td|th|h[1-6]|section|article|blockquote|hr)(?![A-Za-z0-9_])[^>]*>"


def by_locale(x: Column) -> Column:
    """A text that sorts as people expect (the root order of ICU: accents and case come after letters), not by code point."""
    return F.collate(x.cast("string"), "UNICODE")


def js_round(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def tidy_punctuation(text: Column) -> Column:
    """No white space before , ; : . ! ? and inside brackets."""
    t = F.regexp_replace(collapse(text), r" ([,;:.!?])", "$1")
    return F.regexp_replace(F.regexp_replace(t, r"\( ", "("), r" \)", ")")


def clamp(text: Column, most: int) -> Column:
    """At most ``most`` signs, cut after the last word if that keeps over 60 % of them, without trailing punctuation, with an ellipsis."""
    t = collapse(text)
    head = F.substring(t, 1, most)
    words = F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)
    cut = F.when(F.length(words) > most * 0.6, words).otherwise(head)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(cut, r"(?U)[\s,;:.]+$", ""), F.lit("…")))


def _sign_of(code: Column) -> Column:
    """The character of a code point, null for none."""
    fine = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(fine, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def decode_entities(text: Column, names: dict[str, str] | None = None) -> Column:
    """Character references that end in a semicolon, each decoded once; unknown names and impossible numbers stay."""
    table = F.create_map(*[F.lit(x) for pair in (names or ENTITIES).items() for x in pair])

    def one(piece: Column) -> Column:
        body = F.regexp_extract(piece, r"^&(#x?[0-9a-fA-F]+|#X[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);", 1)
        hexed = F.regexp_extract(body, r"^#[xX]0*([0-9a-fA-F]{1,7})$", 1)
        plain = F.regexp_extract(body, r"^#0*([0-9]{1,8})", 1)
        code = F.when(hexed != "", F.conv(hexed, 16, 10).try_cast("long")).when(plain != "", plain.try_cast("long"))
        sign = F.when(F.startswith(body, F.lit("#")), _sign_of(code)).when(body != "", F.try_element_at(table, F.lower(body)))
        return F.when(sign.isNull(), piece).otherwise(F.concat(sign, F.substring(piece, F.length(body) + 3, F.length(piece))))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "(?=&)"), one), "")).otherwise(text)


@F.pandas_udf(T.StringType())
def _fold_any(s: pd.Series) -> pd.Series:
    def one(x):
        return "".join(c for c in unicodedata.normalize("NFKD", x) if not 0x300 <= ord(c) <= 0x36F) if isinstance(x, str) else x

    return s.map(one)


def _fold_table(last: int = 0x17F) -> tuple[str, str, list[str]]:
    """(signs up to ``last`` that change, what they become: the last ones nothing; signs that become several)."""
    folded = {chr(c): "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not 0x300 <= ord(x) <= 0x36F) for c in range(0x80, last + 1)}
    changed = sorted(((c, f) for c, f in folded.items() if f != c and len(f) <= 1), key=lambda x: x[1] == "")
    return "".join(c for c, _ in changed), "".join(f for _, f in changed), [c for c, f in folded.items() if len(f) > 1]


_SIGNS, _PLAIN, _SEVERAL = _fold_table()


def fold_accents(text: Column) -> Column:
    """Compatibility forms and accents folded to plain letters: Latin letters by a table, and only texts with signs that it lacks in Python, where a batch of long texts takes several times its size."""
    beyond = text.rlike("[^\\x00-\\x7F]")
    other = beyond & (text.rlike("[^\\x00-\\x{17F}]") | has_piece(text, _SEVERAL))  # one range: a class of several is an order slower
    return F.when(other, _fold_any(F.when(other, text))).when(beyond, F.translate(text, _SIGNS, _PLAIN)).otherwise(text)


def strip_tags(markup: Column) -> Column:
    """Scripts and styles gone with their content, block tags to spaces, other tags to nothing."""
    t = F.regexp_replace(markup, r"(?is)<(script|style)(?![A-Za-z0-9_])[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?iU)<\s*br\s*/?\s*>", " ")
    t = F.regexp_replace(t, BLOCKS, " ")
    return F.regexp_replace(t, r"<[^>]*>", "")


def html_to_text(markup: Column) -> Column:
    return collapse(decode_entities(strip_tags(F.coalesce(markup, F.lit("")))))


def study_text(markup: Column) -> Column:
    """A study listing's markup as plain text: comments and scripts gone, its own table of character names, zero-width spaces taken for spaces."""
    t = F.regexp_replace(F.coalesce(markup, F.lit("")), r"(?isU)<\s*(script|style)(?![A-Za-z0-9_])[^>]*>.*?<\s*/\s*\1\s*>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), STUDY_BLOCKS, " ")
    t = decode_entities(F.regexp_replace(t, r"<[^>]*>", ""), STUDY_ENTITIES)
    return F.trim(F.regexp_replace(t, r"(?U)[\s\x{200B}]+", " "))


def truncate(text: Column, most: int) -> Column:
    """At most ``most`` signs with the ellipsis, cut after a word if that keeps over 60 % of them, without punctuation at the end."""
    t, room = F.trim(text), most - 1
    head = F.substring(t, 1, room)
    word = F.regexp_extract(head, r"(?s)^(.*) [^ ]*$", 1)
    body = F.regexp_replace(F.when(F.length(word) > room * 0.6, word).otherwise(head), r"(?U)[\s.,;:!?-]+$", "")
    return F.when(F.length(t) <= most, t).otherwise(F.concat(body, F.lit("…")))


def strip_emails(text: Column, marker: str = "[email removed]") -> Column:
    return collapse(F.regexp_replace(text, EMAIL, marker.replace("$", r"\$")))


def looks_like_email(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(f"^{EMAIL}$"), F.lit(False))


#: What is no word: stop words, lone letters, and the nothing before a first or after a last sign.
_DROPPED = [*STOP_WORDS, *"abcdefghijklmnopqrstuvwxyz", ""]


def tokens(text: Column, folded: bool = False) -> Column:
    """Lower-case alphanumeric words of two or more signs (or a digit), without stop words.  ``folded``: accents are gone already."""
    t = text if folded else fold_accents(text)
    return F.filter(F.split(F.lower(F.coalesce(t, F.lit(""))), "[^a-z0-9]+"), lambda w: ~w.isin(_DROPPED))


def cutter():
    """``tokens`` of a text as a Python function that holds no module of ours, so that it can travel: for steps that go on in Python with the words."""
    import re

    marks, word, dropped, fold = re.compile("[\u0300-\u036f]+"), re.compile("[a-z0-9]+"), frozenset(_DROPPED), unicodedata.normalize

    def cut(text: str) -> list[str]:
        return [w for w in word.findall((text if text.isascii() else marks.sub("", fold("NFKD", text))).lower()) if w not in dropped]

    return cut


#: Signs of a text in which its first words are looked for; where they are not all there, the whole text is read.
HEAD = 200


def first_tokens(text: Column, most: int) -> Column:
    """The first ``most`` of ``tokens``, with a space between: long texts aren't cut up for them."""
    cut, long = cutter(), HEAD

    @F.pandas_udf(T.StringType())
    def in_head(heads: pd.Series) -> pd.Series:
        def one(x):
            if not isinstance(x, str) or len(x) < long:
                return " ".join(cut(x)[:most]) if x else ""
            while x and x[-1].isalnum():  # the last word may go on
                x = x[:-1]
            words = cut(x)
            return " ".join(words[:most]) if len(words) >= most else None

        return heads.map(one)

    @F.pandas_udf(T.StringType())
    def in_all(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: " ".join(cut(x)[:most]) if isinstance(x, str) else "")

    sure = in_head(F.substring(text, 1, HEAD))
    return F.coalesce(sure, in_all(F.when(sure.isNull(), text)))


def bigrams(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; empty sets have nothing in common."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def title_similarity(a: Column, b: Column) -> Column:
    return 0.6 * jaccard(a, b) + 0.4 * jaccard(bigrams(a), bigrams(b))


def canonical_title(title: Column, folded: bool = False) -> Column:
    """Words of a title without a leading year and version marks such as v2; & is and."""
    t = F.regexp_replace(collapse(title), "&", " and ")
    t = F.regexp_replace(t, r"^\s*(19|20)\d\d\s+", "")
    return tokens(F.regexp_replace(t, r"(?i)(?<![A-Za-z0-9_])v\d+(?![A-Za-z0-9_])", " "), folded)


def normalize_doi(x: Column) -> Column:
    t = F.lower(F.trim(x))
    for prefix in (r"^https?://(dx\.)?doi\.org/", r"^doi:\s*", r"^info:doi/"):
        t = F.regexp_replace(t, prefix, "")
    return F.nullif(F.regexp_extract(t, r"^(10\.\d{4,9}/\S+)$", 1), F.lit(""))


def normalize_openalex(x: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(x), r"([WASIPCFT]\d{4,})\s*$", 1), F.lit(""))


def normalize_arxiv(x: Column) -> Column:
    t = F.regexp_replace(F.trim(x), r"(?i)^https?://arxiv\.org/abs/", "")
    return F.nullif(F.regexp_extract(t, r"(?i)^([a-z-]+(?:\.[A-Z]{2})?/\d{7}|\d{4}\.\d{4,5})(v\d+)?$", 1), F.lit(""))


def version_of(x: Column) -> Column:
    return F.nullif(F.regexp_extract(F.trim(x), r"(?i)v(\d+)\s*$", 1), F.lit("")).try_cast("int")


def encode_email(x: Column, key: bytes) -> Column:
    """Hex of each sign's code XOR the key, four digits a sign: keeps addresses from harvesters, is no secret."""
    codes = F.transform(F.split(x, ""), lambda c: F.ascii(c))
    k = F.array(*[F.lit(b) for b in key])
    hexed = F.transform(codes, lambda c, i: F.lpad(F.lower(F.hex(c.bitwiseXOR(F.get(k, i % len(key))))), 4, "0"))
    return F.array_join(hexed, "")


def decode_email(x: Column, key: bytes) -> Column:
    k = F.array(*[F.lit(b) for b in key])
    parts = F.regexp_extract_all(x, F.lit("([0-9a-f]{4})"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p, i: _sign_of(F.conv(p, 16, 10).cast("int").bitwiseXOR(F.get(k, i % len(key))))), "")


def url_component(x: Column) -> Column:
    return F.replace(F.url_encode(F.regexp_replace(x, "\r?\n", "\r\n")), F.lit("+"), F.lit("%20"))


def xml_escape(x: Column) -> Column:
    t = F.regexp_replace(x, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def fnv1a(x: Column) -> Column:
    """32-bit FNV-1a over code units, as eight hex digits."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.lpad(F.lower(F.hex(F.aggregate(F.split(x, ""), F.lit(2166136261).cast("long"), step))), 8, "0")


def sentences(text: Column) -> Column:
    parts = F.split(text, r"\n+|(?<=[.!?])\s+(?=[A-Z$0-9])")
    return F.filter(F.transform(parts, collapse), lambda s: s != "")


def padded(*parts: Column) -> Column:
    """Words between single spaces, with one at either end, for whole-phrase tests."""
    t = F.lower(F.concat_ws(" ", *parts))
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(t, "[^a-z0-9]+", " ")), F.lit(" "))


def first_words(hay: Column, phrases: list[str]) -> Column:
    """Those first words of ``phrases`` that are words of the padded text: one pass over its words for any number of phrases."""
    return F.array_intersect(F.array(*[F.lit(w) for w in dict.fromkeys(p.split(" ")[0] for p in phrases)]), F.split(hay, " "))


def has_any(hay: Column, phrases: list[str], seen: Column | None = None) -> Column:
    """One alternation for a whole phrase list instead of a test for each.  ``seen``: ``first_words`` of these phrases and perhaps of others; where it has none of theirs, the text is not read again."""
    import re

    found = hay.rlike("(?: )(?:" + "|".join(re.escape(p).replace(r"\ ", " ") for p in phrases) + ")(?: )")
    return found if seen is None else F.arrays_overlap(seen, F.array(*[F.lit(w) for w in dict.fromkeys(p.split(" ")[0] for p in phrases)])) & found


def has_piece(text: Column, pieces: list[str]) -> Column:
    """Whether one of ``pieces`` stands in the text, inside words too."""
    out = F.contains(text, F.lit(pieces[0]))
    for x in pieces[1:]:
        out = out | F.contains(text, F.lit(x))
    return out


def searchable(*parts: Column, folded: bool = False) -> Column:
    """The texts' words (``tokens``) between single spaces, with one at either end."""
    words = tokens(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]), folded)
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


# Markup helpers: every element or attribute of one name in a text, for feeds read without a schema.


def xml_all(text: Column, tag: str) -> Column:
    """Inner markup of each ``tag`` element, in order; an empty element gives an empty string."""
    found = F.regexp_extract_all(text, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?(?:/>|>(.*?)</{tag}\s*>)"), F.lit(1))
    return F.transform(found, lambda x: F.coalesce(x, F.lit("")))


def _xml_plain(inner: Column) -> Column:
    return collapse(decode_entities(F.regexp_replace(inner, r"<[^>]*>", "")))


def xml_texts(text: Column, tag: str) -> Column:
    """Plain texts of each ``tag`` element, without empty ones."""
    return F.filter(F.transform(xml_all(text, tag), _xml_plain), lambda x: x != "")


def xml_text(text: Column, tag: str, plain=_xml_plain) -> Column:
    """Plain text of the first ``tag`` element, empty or not; null where there is none.  ``plain``: what makes text of its markup."""
    return F.get(F.transform(xml_all(text, tag), plain), F.lit(0))


def xml_attributes(text: Column, tag: str, name: str, decode=decode_entities) -> Column:
    """Values of attribute ``name`` of each ``tag`` element that has it."""
    heads = F.regexp_extract_all(text, F.lit(rf"(?is)<{tag}(\s[^>]*?)/?>"), F.lit(1))
    values = F.transform(heads, lambda h: F.regexp_extract(h, rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*')", 1))
    return F.transform(F.filter(values, lambda v: v != ""), lambda v: decode(F.substring(v, 2, F.length(v) - 2)))
