"""One consistent form for texts that look the same (problem 4).

Every code point is taken to what it looks like: compatibility forms that only
change width, joining or the number of letters are resolved; invisible
characters vanish; every blank is a space; a code point of any script goes to
the prototype that Unicode's confusable data give it. Those data come from the
ICU library among Spark's own jars, so no table is kept here. Other than in
ICU's skeleton, ASCII characters never merge with each other; where a prototype
stands for several of them (``I l 1 |``) the code point's category decides.
Superscripts, subscripts, fractions and circled forms keep their shape.

Then each token (a run without blanks) is spelled in one script: the script
sets of its characters are intersected; where some characters have no
counterpart in Latin and all of those agree on a script, the prototypes are
spelled in that script if it has a lookalike for each, else they stay. The form
depends on the prototypes alone, so texts that look the same get the same form,
and the respelling is one to one, so others don't.

Defined results: null gives null, '' gives ''; a text of invisible characters
gives ''; blanks are neither merged nor trimmed.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tags of compatibility mappings that leave the look as it is.
SAME_LOOK_TAGS = {"<wide>", "<narrow>", "<compat>", "<noBreak>", "<square>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: Code points without a shape that are neither format characters nor variation selectors.
SHAPELESS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0}
#: The scripts of Unicode; those that the installed tables don't know yet are left out.
SCRIPTS = tuple(
    """
    Adlam Ahom Anatolian_Hieroglyphs Arabic Armenian Avestan Balinese Bamum Bassa_Vah Batak Bengali Bhaiksuki Bopomofo Brahmi Braille Buginese Buhid
    Canadian_Aboriginal Carian Caucasian_Albanian Chakma Cham Cherokee Chorasmian Coptic Cuneiform Cypriot Cypro_Minoan Cyrillic Deseret Devanagari
    Dives_Akuru Dogra Duployan Egyptian_Hieroglyphs Elbasan Elymaic Ethiopic Garay Georgian Glagolitic Gothic Grantha Greek Gujarati Gunjala_Gondi Gurmukhi
    Gurung_Khema Han Hangul Hanifi_Rohingya Hanunoo Hatran Hebrew Hiragana Imperial_Aramaic Inscriptional_Pahlavi Inscriptional_Parthian Javanese Kaithi
    Kannada Katakana Kawi Kayah_Li Kharoshthi Khitan_Small_Script Khmer Khojki Khudawadi Kirat_Rai Lao Latin Lepcha Limbu Linear_A Linear_B Lisu Lycian
    Lydian Mahajani Makasar Malayalam Mandaic Manichaean Marchen Masaram_Gondi Medefaidrin Meetei_Mayek Mende_Kikakui Meroitic_Cursive
    Meroitic_Hieroglyphs Miao Modi Mongolian Mro Multani Myanmar Nabataean Nag_Mundari Nandinagari New_Tai_Lue Newa Nko Nushu Nyiakeng_Puachue_Hmong Ogham
    Ol_Chiki Ol_Onal Old_Hungarian Old_Italic Old_North_Arabian Old_Permic Old_Persian Old_Sogdian Old_South_Arabian Old_Turkic Old_Uyghur Oriya Osage
    Osmanya Pahawh_Hmong Palmyrene Pau_Cin_Hau Phags_Pa Phoenician Psalter_Pahlavi Rejang Runic Samaritan Saurashtra Sharada Shavian Siddham SignWriting
    Sinhala Sogdian Sora_Sompeng Soyombo Sundanese Sunuwar Syloti_Nagri Syriac Tagalog Tagbanwa Tai_Le Tai_Tham Tai_Viet Takri Tamil Tangsa Tangut Telugu
    Thaana Thai Tibetan Tifinagh Tirhuta Todhri Toto Tulu_Tigalari Ugaritic Vai Vithkuqi Wancho Warang_Citi Yezidi Yi Zanabazar_Square
    """.split()
)


def icu_skeletons(spark: SparkSession) -> dict[int, str]:
    """Unicode's confusable prototype of each assigned code point that has another one than itself.

    The size is bounded by Unicode itself (about 20 000 entries).
    """
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    points = [c for c in (*range(0x21, 0xD800), *range(0xF900, 0x30000)) if unicodedata.category(chr(c))[0] not in "CZ"]
    found: dict[int, str] = {}
    for at in range(0, len(points), 20_000):
        block = points[at : at + 20_000]
        for c, looks in zip(block, checker.getSkeleton("\n".join(map(chr, block))).split("\n"), strict=True):
            if looks != chr(c):
                found[c] = looks
    return found


def invisible(ch: str) -> bool:
    c = ord(ch)
    if unicodedata.category(ch) in ("Cf", "Cc"):
        return not ch.isspace()
    return c in SHAPELESS or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF


def shape_table(skeletons: dict[int, str]) -> dict[int, str]:
    """What each code point looks like, for ``str.translate``; without entry: itself."""
    ascii_of: dict[str, list[str]] = {}
    for c in range(0x21, 0x7F):
        ascii_of.setdefault(skeletons.get(c, chr(c)), []).append(chr(c))

    def prototype(ch: str) -> str:
        looks = skeletons.get(ord(ch))
        if looks is None:
            return ch
        same = ascii_of.get(looks, [])
        if len(same) < 2:
            return same[0] if same else looks
        kind = unicodedata.category(ch)
        value = unicodedata.numeric(ch, None) if kind[0] == "N" else None
        for a in same:
            if value is not None and a.isdigit() and int(a) == value:
                return a
        if "`" in same:
            return "`" if "GRAVE" in unicodedata.name(ch, "") else "'"
        if kind == "Lu" and "I" in same:
            return "I"
        if kind[0] in "LN":
            return "l" if "l" in same else "O"
        return "|" if "|" in same else same[0]

    def shape(ch: str) -> str:
        if ord(ch) < 0x80:
            return " " if ch.isspace() else "" if invisible(ch) else ch
        if ch.isspace() or ch == "⠀":
            return " "
        if invisible(ch):
            return ""
        parts = unicodedata.decomposition(ch).split()
        if parts and (not parts[0].startswith("<") or parts[0] in SAME_LOOK_TAGS and parts[1] != "0020"):
            return "".join(shape(chr(int(p, 16))) for p in parts if not p.startswith("<"))
        return prototype(ch)

    table = {}
    for c in (*range(0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0200)):
        ch = chr(c)
        if 0xAC00 <= c <= 0xD7A3 or (looks := shape(ch)) == ch:
            continue
        table[c] = looks
    return table


def look_key(text: str, table: dict[int, str]) -> str:
    """Equal for texts that look the same, different for others."""
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(table))


def script_patterns(names: tuple[str, ...] = SCRIPTS) -> dict[str, regex.Pattern]:
    found = {}
    for s in names:
        try:
            found[s] = regex.compile(rf"\p{{Script_Extensions={s}}}")
        except regex.error:
            continue
    return found


SCRIPT_PATTERNS = script_patterns()
SHARED = regex.compile(r"[\p{Script=Common}\p{Script=Inherited}]")


def scripts_of(ch: str, _known: dict = {}) -> frozenset[str] | None:  # noqa: B006
    """The scripts a character is used in; None for one that all share."""
    if ch not in _known:
        _known[ch] = _scripts_of(ch)
    return _known[ch]


def _scripts_of(ch: str) -> frozenset[str] | None:
    if unicodedata.category(ch)[0] not in "LM" or SHARED.match(ch):
        return None
    found = frozenset(s for s, p in SCRIPT_PATTERNS.items() if p.match(ch))
    if found & {"Han", "Hiragana", "Katakana", "Hangul"}:
        found |= {"Japanese", "Korean", "Han"} if "Han" in found else {"Japanese"} if found & {"Hiragana", "Katakana"} else {"Korean"}
    return found or frozenset({"other"})


def resolved_scripts(token: str) -> frozenset[str] | None:
    """The scripts that every character of the token is used in; None: any."""
    left = None
    for ch in token:
        own = scripts_of(ch)
        if own is not None:
            left = own if left is None else left & own
    return left


def spellings(table: dict[int, str]) -> dict[str, dict[str, str]]:
    """By script, the letter of that script that looks like a Latin letter."""
    found: dict[str, dict[str, str]] = {}
    for c, looks in table.items():
        ch = chr(c)
        if len(looks) == 1 and looks.isascii() and looks.isalpha() and not unicodedata.decomposition(ch):
            own = scripts_of(ch)
            if own and len(own) == 1 and unicodedata.category(ch) in (("Lu",) if looks.isupper() else ("Ll",)):
                found.setdefault(next(iter(own)), {}).setdefault(looks, ch)
    return found


def homes(table: dict[int, str]) -> dict[str, frozenset[str]]:
    """By prototype of one letter, the scripts that have a letter of that look."""
    found: dict[str, set[str]] = {}
    for c, looks in table.items():
        if len(looks) == 1 and looks.isalpha() and not unicodedata.decomposition(chr(c)):
            for ch in (looks, chr(c)):
                found.setdefault(looks, set()).update(s for s in scripts_of(ch) or () if s in SCRIPT_PATTERNS)
    return {k: frozenset(v) for k, v in found.items()}


def consistent_form(key: str, letters: dict[str, dict[str, str]]) -> str:
    """The key's tokens in one script each, composed."""
    if key.isascii():
        return key
    tokens = key.split(" ")
    for i, token in enumerate(tokens):
        if token.isascii():
            continue
        own = resolved_scripts("".join(ch for ch in token if not ch.isascii()))
        if own and len(own) == 1 and (way := letters.get(next(iter(own)))):
            latin = {ch for ch in token if ch.isascii() and ch.isalpha()}
            if latin and latin <= way.keys():
                tokens[i] = "".join(way.get(ch, ch) if ch in latin else ch for ch in token)
    return unicodedata.normalize("NFC", " ".join(tokens))


def token_state(text: str, table: dict[int, str], where: dict[str, frozenset[str]] | None = None) -> str:
    """'mixed': a token joins scripts; 'whole': a token reads as one of another script; 'form': only forms differ; 'plain'.

    A token that Latin can spell is never 'whole'. ``where`` is ``homes`` of the
    table; without it only Latin is looked for.
    """
    state = "plain"
    if text.isascii() and text.isprintable():
        return state
    for token in text.split():
        own = resolved_scripts(token)
        if own is not None and not own:
            return "mixed"
        key = look_key(token, table)
        letters = [ch for ch in key if ch.isalpha()]
        if own and "Latin" not in own and letters and (key.isascii() or where and other_scripts(letters, where) - own):
            state = "whole"
        elif key != unicodedata.normalize("NFD", token) and state == "plain":
            state = "form"
    return state


def other_scripts(letters: list[str], where: dict[str, frozenset[str]]) -> frozenset[str]:
    """The scripts that have a letter of each look."""
    found = None
    for ch in letters:
        own = where.get(ch)
        if not own:
            return frozenset()
        found = own if found is None else found & own
    return found or frozenset()


#: Texts that are their own form.
PLAIN = r"^[ -~]*$"


class Lookalikes:
    """Column functions over one broadcast shape table."""

    def __init__(self, spark: SparkSession) -> None:
        table = shape_table(icu_skeletons(spark))
        self.shared = spark.sparkContext.broadcast((table, spellings(table), homes(table)))

    def key(self, text: Column) -> Column:
        shared = self.shared

        @F.pandas_udf("string")
        def run(s: pd.Series) -> pd.Series:
            table = shared.value[0]
            return s.map(lambda x: None if x is None else look_key(x, table))

        return run(text)

    def form(self, text: Column) -> Column:
        """``struct<form, state>`` of the text; see ``consistent_form`` and ``token_state``. Plain ASCII stays in the JVM."""
        shared = self.shared

        @F.pandas_udf("struct<form:string,state:string>")
        def run(s: pd.Series) -> pd.DataFrame:
            table, letters, where = shared.value
            rows = [(None, None) if x is None else (consistent_form(look_key(x, table), letters), token_state(x, table, where)) for x in s]
            return pd.DataFrame(rows, columns=["form", "state"])

        plain = text.rlike(PLAIN)
        found = run(F.when(~plain, text))
        return F.struct(F.when(plain, text).otherwise(found["form"]).alias("form"), F.when(plain, F.lit("plain")).otherwise(found["state"]).alias("state"))


def same_look_pairs(cells: DataFrame, sections: DataFrame) -> DataFrame:
    """``(source_ref, section_id)`` of one document whose texts look the same and aren't the same.

    Texts are compared as distinct (document, text) forms first, so repeated
    rows cost one comparison; only pairs that are results are expanded.
    """
    looks = Lookalikes(cells.sparkSession)
    a = cells.where("text <> ''").select("source_ref", "document_id", "text").distinct()
    b = sections.where("heading <> ''").select("section_id", "document_id", "heading").distinct()
    forms_a = a.select("document_id", "text").distinct().withColumn("form", looks.form(F.col("text"))["form"])
    forms_b = b.select("document_id", "heading").distinct().withColumn("form", looks.form(F.col("heading"))["form"])
    pairs = forms_a.join(forms_b, ["document_id", "form"]).where("text <> heading").select("document_id", "text", "heading")
    return pairs.join(a, ["document_id", "text"]).join(b, ["document_id", "heading"]).select("source_ref", "section_id").distinct()
