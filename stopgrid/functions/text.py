"""String functions of names: folding, and stripping of quays, poles and lines. All are Column functions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that keep their form when accents are stripped, and what they fold to.
LIGATURES = {"æ": "ae", "œ": "oe", "ß": "ss", "ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ı": "i"}

# The words before a quay's code, in and outside parentheses.
QUAY_WORDS = "[Qq]uai|[Qq]uay|[Bb]ay|[Ss]tand|[Vv]oie|[Pp]latform|[Pp]lateforme"
MORE_QUAY_WORDS = "[Pp]erron|[Bb]ahnsteig|[Aa]ndén|[Bb]inario|[Ss]por|[Ll]aituri"
LINE_WORDS = "m[ée]tro|rer|tram(?:way)?|ligne|line|linie|lijn|linea|línea|u-?bahn|s-?bahn|stadtbahn|subway|bus|trolleybus"

SPACE = r"[\t\n\f\r ]"
QUAY = rf"{SPACE}\((?:(?:{QUAY_WORDS}){SPACE}+)?([A-Z]{{1,2}}[0-9]{{0,2}}|[0-9]{{1,2}}[A-Z]?)\)\z"
QUAY_CODE = rf"^(?:(?:{QUAY_WORDS}|{MORE_QUAY_WORDS}){SPACE}*(?:n[°o]\.?{SPACE}*)?)?([A-Z]{{1,2}}[0-9]{{0,2}}|[0-9]{{1,3}}[A-Z]?)\z"
LINE = rf"(?iu){SPACE}*[(\[](?:{LINE_WORDS})(?![0-9A-Za-z_])[^)\]]*[)\]]{SPACE}*\z"
#: Scripts that leave no space after a place: kana and Han.
UNSPACED = "^[぀-ヿ㐀-䶿一-鿿]+"
PLACE_KEYS = ("name", "name:en", "name:zh", "name:zh-Hans", "name:ja", "name:ko", "name:ru", "name:uk")
CODE_KEYS = ("railway:ref", "ref:crs", "ref:tiploc", "ref:FR:sncf:resarail", "ref:amtrak", "uic_ref", "ref:ibnr", "esr:user")


@cache
def accents() -> tuple[str, str]:
    """Characters with marks and, at the same places, those without; at the end the marks alone, which go. Built from the Unicode tables."""
    kept, bare, gone = [], [], []
    for code in range(0xA0, 0x30000):
        c = chr(code)
        if 0xAC00 <= code <= 0xD7A3 or 0xD800 <= code <= 0xDFFF:
            continue
        base = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.category(x).startswith("M")))
        if base == c:
            continue
        if not base:
            gone.append(c)
        elif len(base) == 1:
            kept.append(c)
            bare.append(base)
    return "".join(kept + gone), "".join(bare)


def strip_accents(s: Column) -> Column:
    return F.translate(s, *accents())


def fold(s: Column) -> Column:
    """Lower case without accents and ligatures; null folds to the empty string."""
    out = F.lower(F.coalesce(s, F.lit("")))
    for a, b in LIGATURES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return strip_accents(out)


def _words(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"[^\p{L}\p{Nd}]+", " "))


def search_fold(s: Column) -> Column:
    """What names and queries are compared on: folded, without apostrophes, other signs as single spaces."""
    return _words(F.translate(fold(s), "'’", ""))


def elision_fold(s: Column) -> Column:
    """As search_fold, with an apostrophe as a word break."""
    return _words(fold(s))


def _capture(s: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(s, pattern, 1), F.lit(""))


def without_quay(s: Column) -> Column:
    return F.regexp_replace(s, SPACE + "+" + QUAY.removeprefix(SPACE), "")


def quay_of(s: Column) -> Column:
    return _capture(s, QUAY)


def quay_code(s: Column) -> Column:
    return _capture(s, QUAY_CODE)


def is_quay_code(s: Column) -> Column:
    return quay_code(s).isNotNull()


def without_line(s: Column) -> Column:
    return F.regexp_replace(s, LINE, "")


def pole_of(s: Column, poles: Column) -> Column:
    """The two digits that a stop's name ends in where names end in poles, unless they are a number (nr, no)."""
    numbered = s.rlike(rf"(?<![0-9A-Za-z_])(?:[Nn]r|[Nn]o)\.?{SPACE}*[0-9]{{2}}\z")
    return F.when(poles & s.rlike(rf"{SPACE}[0-9]{{2}}\z") & ~numbered, F.right(s, F.lit(2)))


def without_pole(s: Column, ref: Column, poles: Column) -> Column:
    def cut(n: Column) -> Column:
        return F.rtrim(F.substring(s, F.lit(1), F.length(s) - n))

    repeated = poles & ref.rlike(r"^[0-9]{3,}\z") & s.endswith(F.concat(F.lit(" "), ref))
    return F.when(pole_of(s, poles).isNotNull(), cut(F.lit(2))).when(repeated, cut(F.length(ref))).otherwise(s)


def town_stripped(s: Column) -> Column:
    """Without a town before the first spaced dash."""
    return F.regexp_replace(s, rf"^.+?{SPACE}+-{SPACE}+", "")


def name_runs(name: Column) -> Column:
    """Every run of one to five words, and the proper beginnings (two characters and more) of what is written in Han or kana."""
    words = F.split(name, " ")
    starts = F.sequence(F.lit(1), F.size(words))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(i, F.least(i + 4, F.size(words))), lambda j: F.array_join(F.slice(words, i, j - i + 1), " "))))
    head = F.regexp_extract(name, UNSPACED, 0)
    none = F.expr("cast(array() as array<string>)")
    heads = F.when(F.length(head) > 2, F.transform(F.sequence(F.lit(2), F.length(head) - 1), lambda n: F.substring(head, F.lit(1), n))).otherwise(none)
    return F.when(F.coalesce(name, F.lit("")) == "", none).otherwise(F.concat(runs, heads))


def word_runs(a: Column, b: Column, c: Column) -> Column:
    return F.concat(name_runs(a), name_runs(b), name_runs(c))


def is_code_key(k: Column) -> Column:
    """Whether a tag key names an operator's code of a station."""
    more = k.rlike(r"^railway:ref:.+\z") & ~k.isin("railway:ref:parent", "railway:ref:count") & ~k.rlike(r"^railway:ref:(?:[a-z]{2}|[0-9]+)\z")
    return k.isin(*CODE_KEYS) | more


def place_tags(tags: Column) -> Column:
    return F.map_filter(tags, lambda k, v: k.isin(*PLACE_KEYS))


# Words of administrative units that a place's bare name does without.
UNIT_WORDS = (
    "region regione capital capitale hoofdstedelijk gewest district city ville of de du des la le the metropolitan greater gemeinde stadt kreis landkreis "
    "oblast raion rayon okrug province provincia prefecture municipality municipio commune county kommune fylke"
).split()


def bare_name(folded: Column) -> Column:
    out = F.regexp_replace(folded, rf"(?<![0-9A-Za-z_])(?:{'|'.join(UNIT_WORDS)})(?![0-9A-Za-z_])", "")
    return F.trim(F.regexp_replace(out, rf"{SPACE}+", " "))


def track_ref(part: Column) -> Column:
    """A track's ref without its word; a number and a word joined to it are set apart."""
    out = F.regexp_replace(F.trim(part), rf"(?iu)^(?:voie|gleis|gl\.?|track|platform|quai|binario|v[ií]a|spoor|tor|peron){SPACE}*", "")
    return F.regexp_replace(out, rf"^([0-9]+){SPACE}*(\p{{L}}{{3,}})\z", "$1 $2")


def is_track(ref: Column) -> Column:
    return ref.rlike(r"^(?:[0-9]{1,3}|[0-9]{1,2}[A-Za-z]|[A-Za-z]{1,2}[0-9]{0,2}|[0-9]{1,3} \p{L}{3,})\z")
