"""Name normalisation as column expressions; no Python UDF."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Indexed and queried prefix, in bytes.
PREFIX = 30
GRAM = 3

# Romanisation of letters that Unicode's own decomposition does not reduce to ASCII (fixed values).
_LATIN = {"ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d", "Þ": "Th", "þ": "th", "Ł": "L", "ł": "l", "ı": "i", "ŋ": "ng", "Ŋ": "NG", "ħ": "h", "Ħ": "H"}
_GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split(), strict=True))
_CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяіїєґў", "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch ' y ' e iu ia i yi ie g u".split(), strict=True))
_HEBREW = dict(zip("אבגדהוזחטיךכלםמןנסעףפץצקרשת", "a b g d h v z kh t y k k l m m n n s a p p ts ts q r sh t".split(), strict=True))
_ARMENIAN = dict(zip("աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆև", "a b g d e z e e t` zh i l kh ts k h dz gh ch m y n sh o ch` p j rh s v t r ts` w p` k` o f ew".split(), strict=True))
_GEORGIAN = dict(zip("აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ", "a b g d e v z t` i k l m n o p' zh r s t' u p` k` g' q' sh ch` c` z' c' ch x j h".split(), strict=True))
_ARABIC = dict(zip("بتثجحخدذرزسشصضطظعغفقكلمنهوي", "b t th j H kh d dh r z s sh S D T Z ` G f q k l m n h w y".split(), strict=True))
_DEVANAGARI = dict(zip("अआइईउऊएऐओऔकखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसह", "a aa i ii u uu e ai o au k kh g gh ng c ch j jh ny tt tth dd ddh nn t th d dh n p ph b bh m y r l v sh ss s h".split(), strict=True))
_THAI = dict(zip("กขฃคฅฆงจฉชซฌญฎฏฐฑฒณดตถทธนบปผฝพฟภมยรฤลฦวศษสหฬอฮะาำเแโใไ", "k kh kh kh kh kh ng cch ch ch ch ch y d t th th th n d t th th th n b p ph f ph f ph m y r R l L w s s s h l ` h a aa am e ae o ai ai".split(), strict=True))
# Hangul syllables are composed of these, by the code point's arithmetic (fixed values).
_LEAD = "g gg n d dd r m b bb s ss - j jj c k t p h".replace("-", "").split(" ")
_VOWEL = "a ae ya yae eo e yeo ye o wa wae oe yo u weo we wi yu eu yi i".split(" ")
_TAIL = " g gg gs n nj nh d l lg lm lb ls lt lp lh m b bs s ss ng j c k t p h".split(" ")


@cache
def romanisation() -> dict[str, str]:
    """One character to ASCII, for Latin, Greek, Cyrillic, Hebrew, Armenian, Georgian, Arabic, Devanagari, Thai, kana, full-width forms and decimal digits: from lists, decomposition and character names."""
    out: dict[str, str] = {}
    for low in (_GREEK, _CYRILLIC, _HEBREW, _ARMENIAN):
        out |= low | {k.upper(): v.capitalize() for k, v in low.items() if k.upper() != k and len(k.upper()) == 1}
    out |= _LATIN | _GEORGIAN | _ARABIC | _DEVANAGARI | _THAI
    out |= {chr(zero + k): str(k) for zero in (0x660, 0x6F0, 0x966, 0xE50) for k in range(10)}
    for code in [*range(0x80, 0x590), *range(0x1E00, 0x2000), *range(0x3041, 0x3100), *range(0xFF01, 0xFF5F)]:
        c = chr(code)
        if c in out:
            continue
        name = unicodedata.name(c, "")
        if name.startswith(("HIRAGANA LETTER ", "KATAKANA LETTER ")):
            out[c] = name.rsplit(" ", 1)[1].lower()
            continue
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        plain = "".join(out.get(x, x) for x in plain).replace("⁄", "/")
        if plain.isascii() and plain.strip():
            out[c] = plain
    return out


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def romanise(x: Column) -> Column:
    """Unicode to ASCII.  One-to-one letters by ``translate``; only strings that then still hold others are walked letter by letter.  Letters without a rule (ideographs) drop out."""
    table = romanisation()
    single = {k: v for k, v in table.items() if len(v) == 1}
    longer = {k: v for k, v in table.items() if len(v) > 1}
    simple = F.translate(x, "".join(single), "".join(single.values()))
    # a few foldable expressions instead of hundreds of literals
    by_letter = F.map_from_arrays(F.split(F.lit(" ".join(longer)), " "), F.split(F.lit(" ".join(longer.values())), " "))
    lead, vowel, tail = (F.split(F.lit(",".join(part)), ",", -1) for part in (_LEAD, _VOWEL, _TAIL))

    def letter(c: Column) -> Column:
        code = F.ascii(c)
        syllable = code - 0xAC00
        hangul = F.concat(F.get(lead, F.floor(syllable / 588).cast("int")), F.get(vowel, F.floor(syllable % 588 / 28).cast("int")), F.get(tail, (syllable % 28).cast("int")))
        return F.when(code < 128, c).when((syllable >= 0) & (syllable < 11172), hangul).otherwise(F.coalesce(F.try_element_at(by_letter, c), F.lit("")))

    walked = F.array_join(F.transform(F.filter(F.split(simple, ""), lambda c: c != ""), letter), "")
    return F.when(x.rlike("^[\\x00-\\x7F]*$"), x).otherwise(F.when(simple.rlike("^[\\x00-\\x7F]*$"), simple).otherwise(walked))


def encode_name(x: Column) -> Column:
    """A name's comparable key: letters and digits only, romanised, lower case, no space or underscore."""
    return F.regexp_replace(ascii_lower(romanise(F.regexp_replace(x, "[^\\p{L}\\p{N}_]+", ""))), "[ _]+", "")


def encode_symbols(x: Column) -> Column:
    """The key of names without letters or digits: white space removed, A-Z lower-cased, not romanised."""
    return ascii_lower(F.regexp_replace(x, "[\\s\\p{Z}]+", ""))


def byte_view(x: Column) -> Column:
    """One character for each UTF-8 byte, so that lengths and substrings count bytes."""
    return F.decode(F.encode(x, "UTF-8"), "ISO-8859-1")


def truncate(x: Column, size: int = PREFIX) -> Column:
    return F.substring(x, 1, size)


def trigrams(x: Column) -> Column:
    """All character 3-grams; shorter texts are padded with spaces to one."""
    padded = F.when(F.length(x) < GRAM, F.rpad(x, GRAM, " ")).otherwise(x)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - (GRAM - 1), F.lit(1))), lambda i: F.substr(padded, i, F.lit(GRAM)))


def is_transliterated(name: Column, sort_name: Column) -> Column:
    """The name mixes Latin and other scripts while the sort name is Latin only."""
    latin, other = "[\\x{0}-\\x{24F}]", "[^\\x{0}-\\x{24F}]"
    return name.rlike(latin) & name.rlike(other) & ~sort_name.rlike(other)


def joined_sort_names(names: Column, join_phrases: Column) -> Column:
    """Each name followed by its join phrase."""
    return F.array_join(F.zip_with(names, join_phrases, lambda n, j: F.concat(F.coalesce(n, F.lit("")), F.coalesce(j, F.lit("")))), "")


def reduce_aliases(aliases: Column, name: Column) -> Column:
    """Encoded aliases, distinct and sorted, without empty ones and the name itself."""
    key = encode_name(name)
    return F.array_sort(F.array_distinct(F.filter(F.transform(aliases, encode_name), lambda a: (a != "") & (a != key))))


def encode_or_keep(names: Column) -> Column:
    """Distinct encoded names; a name that encodes to nothing stays as it is."""
    return F.array_sort(F.array_distinct(F.transform(names, lambda n: F.when(encode_name(n) != "", encode_name(n)).otherwise(n))))


def clean_name(x: Column) -> Column:
    """A name without bracketed parts, featured guests and a leading article."""
    out = F.regexp_replace(x, "\\s*[(\\[{][^)\\]}]*[)\\]}]", "")
    out = F.regexp_replace(out, "(?i)\\s+(feat|featuring|ft|vs|with)\\b\\.?.*$", "")
    return F.trim(F.regexp_replace(out, "(?i)^the\\s+", ""))


def url_encode(x: Column) -> Column:
    """Percent-encoding of all but A-Z a-z 0-9 - _ . ~"""
    return F.replace(F.replace(F.replace(F.url_encode(x), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def split_list(x: Column, *, trim: bool = False) -> Column:
    parts = F.split(x, ",", -1)
    return F.transform(parts, lambda p: F.trim(p)) if trim else parts


def join_list(x: Column) -> Column:
    return F.array_join(x, ",")


def two_decimals(x: Column) -> Column:
    return F.format_string("%.2f", x.cast("double"))


def clip(x: Column, width: int) -> Column:
    return F.substring(x, 1, width)


def to_int(x: Column) -> Column:
    return x.try_cast("int")


def parse_array_literal(x: Column) -> Column:
    """``{a,"b,c"}`` to its elements; quotes inside quotes are doubled or escaped.  Anything without braces has none."""
    body = F.regexp_extract(x, "(?s)^\\{(.*)\\}$", 1)
    raw = F.regexp_extract_all(F.concat(F.lit(","), body), F.lit('(?s),("(?:[^"\\\\]|\\\\.|"")*"|[^,]*)'), F.lit(1))
    quoted = lambda e: F.regexp_replace(F.replace(F.substr(e, F.lit(2), F.length(e) - 2), F.lit('""'), F.lit('"')), "(?s)\\\\(.)", "$1")
    return F.when(x.rlike("(?s)^\\{.*\\}$"), F.transform(raw, lambda e: F.when(F.startswith(e, F.lit('"')), quoted(e)).otherwise(e))).otherwise(F.array().cast("array<string>"))


def strip_braces(x: Column) -> Column:
    """``{a,b}`` to ``a,b``; shorter or other texts unchanged."""
    return F.when((F.length(x) > 2) & x.rlike("(?s)^\\{.*\\}$"), F.substr(x, F.lit(2), F.length(x) - 2)).otherwise(x)


def first_element(x: Column) -> Column:
    return F.get(x, F.lit(0))


def null_to_default(x: Column, kind: str) -> Column:
    """Null numbers are 0, null texts empty."""
    return F.coalesce(x, F.lit("") if kind == "string" else F.lit(0).cast(kind))
