"""One consistent form of texts that look the same.

The form is a skeleton: decompose canonically, replace every character by its prototype, decompose again. Prototypes of letters
come from the table of confusable characters of the ICU library that Spark ships (:func:`confusables`), as far as a
letter looks like one of another script (:func:`letter_prototypes`). The others follow from the Unicode data of the running
Python by rule: full- and half-width forms become their normal forms, every blank becomes a space, invisible characters
vanish, ligature letters are taken apart. Everything else that shows is kept: case, accents, position (superscripts), long s,
digits, punctuation, the number of blanks, line breaks.
"""

from __future__ import annotations

import glob
import hashlib
import os
import struct
import unicodedata
import zipfile
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, functions as F

from skein.functions.tables import durable

# Letters that look like a Latin letter, which the library's table lacks or has in their own script, and that letter.
ADDED = ("ıȷϲϹԚ", "ijcCQ")
# Characters without a glyph that are not of category Cf.
INVISIBLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
# Characters of category Cf that do have a glyph.
SHOWN = [*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD]
# Blocks of phonetic letters, which Unicode counts among the Latin ones.
PHONETIC = [(0x0250, 0x02B0), (0x1D00, 0x1DC0), (0xAB30, 0xAB70)]
# Scripts whose letters are never replaced.
KEPT_SCRIPTS = {"", "LATIN", "CJK", "HANGUL", "HIRAGANA", "KATAKANA"}


@lru_cache(maxsize=1)
def confusables() -> dict[str, str]:
    """Each character of ICU's table and its prototype, from the library among Spark's jars.

    The table is a list of code points with the lengths of their prototypes, and a list of the prototypes: a single
    character as it is, a longer one as a position in a string.
    """
    roots = [os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__)]
    jars = [j for r in roots if r for j in sorted(glob.glob(f"{r}/jars/icu4j-*.jar"))]
    if not jars:
        raise FileNotFoundError("no icu4j library among Spark's jars")
    with zipfile.ZipFile(jars[-1]) as jar:
        data = jar.read(next(n for n in jar.namelist() if n.endswith("/confusables.cfu")))
    data = data[struct.unpack_from(">H", data)[0] :]
    keys_at, keys, index_at, _, text_at, _ = struct.unpack_from(">6I", data, 12)
    found = {}
    for i in range(keys):
        key, value = struct.unpack_from(">I", data, keys_at + 4 * i)[0], struct.unpack_from(">H", data, index_at + 2 * i)[0]
        size, at = (key >> 24) + 1, text_at + 2 * value
        found[chr(key & 0xFFFFFF)] = chr(value) if size == 1 else data[at : at + 2 * size].decode("utf-16-be")
    return found


def _script(char: str) -> str:
    """The script of a letter, as its name begins."""
    if any(a <= ord(char) < b for a, b in PHONETIC):
        return "PHONETIC"
    return unicodedata.name(char, "").split(" ")[0]


@lru_cache(maxsize=1)
def letter_prototypes() -> tuple[tuple[str, str], ...]:
    """Letters and the letter of another script that each looks like.

    Taken over are letters without a compatibility decomposition (so no superscripts and no styled ones) whose prototype is
    a single letter of another script; phonetic letters count as a script. The table merges I with l and m with rn, which
    show differently: capital letters of the first class are I, all others l, and the second one is m.
    """
    found, added = {}, dict(zip(*ADDED, strict=True))
    for char, drawn in confusables().items():
        kind = unicodedata.category(char)
        if kind not in ("Lu", "Ll", "Lt", "Lo") or unicodedata.decomposition(char) or _script(char) in KEPT_SCRIPTS:
            continue
        drawn = {"rn": "m", "l": "I" if kind == "Lu" else "l", **added}.get(drawn, drawn)
        if len(drawn) == 1 and unicodedata.category(drawn) in ("Lu", "Ll", "Lt", "Lo") and _script(drawn) != _script(char):
            found[char] = drawn
    found.update(added)
    return tuple(sorted(found.items()))


@lru_cache(maxsize=2)
def prototypes(letters: tuple[tuple[str, str], ...]) -> dict[int, str]:
    """Code point to prototype, for :meth:`str.translate`, with those of the given letters."""
    found: dict[int, str] = {}
    for code in range(0x110000):
        char = chr(code)
        kind = unicodedata.category(char)
        if kind in ("Cn", "Co", "Cs"):
            continue
        parts = unicodedata.decomposition(char)
        if kind == "Cf" and code not in SHOWN:
            found[code] = ""
        elif kind == "Cc" and char not in "\t\n\v\f\r\x85":
            found[code] = ""
        elif kind == "Zs" or char == "\t":
            found[code] = " "
        elif parts.startswith(("<wide>", "<narrow>")):
            found[code] = unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in parts.split()[1:]))
        elif parts.startswith("<compat>") and kind[0] == "L" and len(parts.split()) > 2:
            found[code] = "".join(chr(int(x, 16)) for x in parts.split()[1:])
    found.update(dict.fromkeys(INVISIBLE, ""))
    found.update({ord(a): b for a, b in letters})
    # a prototype may itself have one: full-width letters never do, ligatures of look-alike letters might
    return {code: "".join(found.get(ord(c), c) if len(p) > 1 else c for c in p) for code, p in found.items()}


def skeleton(text: str, letters: tuple[tuple[str, str], ...] | None = None) -> str:
    """The form shared by all texts that look like ``text``. Workers are given the ``letters``, so only the driver reads the library's table."""
    if text.isascii() and text.isprintable():
        return text
    table = prototypes(letter_prototypes() if letters is None else letters)
    return unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(table))


def _mark(value: str) -> bytes:
    return hashlib.blake2b(value.encode(), digest_size=16).digest()


class _Looks:
    """Texts to fingerprints of their skeletons and of themselves."""

    def __init__(self, letters: tuple[tuple[str, str], ...]):
        self.letters = letters

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, look, text = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                form = skeleton(t, self.letters)
                if not form or form.isspace():
                    continue
                ids.append(i)
                look.append(_mark(form))
                text.append(_mark(t))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(look, pa.binary()), pa.array(text, pa.binary())], ["doc_id", "look", "exact"])


def looks(documents: DataFrame) -> DataFrame:
    """``doc_id, look, exact``: 128-bit fingerprints of each text's skeleton and of the text itself.

    Null, empty and blank texts and those of invisible characters only are left out, as are rows without a doc_id.
    """
    texts = documents.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return texts.mapInArrow(_Looks(letter_prototypes()), "doc_id bigint, look binary, exact binary")


def same_look_pairs(documents: DataFrame) -> DataFrame:
    """``doc_id_a, doc_id_b``: each pair of documents, a < b, whose texts differ but look the same.

    Equal texts are reduced to one variant first and variants are paired by their skeleton, so a group of exact copies, of
    whatever size, costs nothing unless something else looks like it; then only pairs of different texts are made. Repeated
    rows of a doc_id give a pair once; a document is no pair with itself.
    """
    made = durable(looks(documents))
    several = made.groupBy("look").agg(F.min("exact").alias("_a"), F.max("exact").alias("_b")).where("_a <> _b").select("look")
    variant = made.join(several, "look", "left_semi").select("look", "exact").distinct()
    one, two = variant.select("look", F.col("exact").alias("_one")), variant.select("look", F.col("exact").alias("_two"))
    pairs = one.join(two, "look").where("_one < _two").select("_one", "_two")
    a = made.select(F.col("exact").alias("_one"), F.col("doc_id").alias("_x"))
    b = made.select(F.col("exact").alias("_two"), F.col("doc_id").alias("_y"))
    return pairs.join(a, "_one").join(b, "_two").select(F.least("_x", "_y").alias("doc_id_a"), F.greatest("_x", "_y").alias("doc_id_b")).where("doc_id_a < doc_id_b").distinct()


def look_groups(documents: DataFrame) -> DataFrame:
    """``doc_id, group_id, variants``: the smallest doc_id whose text looks the same and how many different texts do.

    One row per row of ``documents``; both are null where the text has no visible character. A doc_id that stands with
    several texts has the smaller group.
    """
    made = durable(looks(documents))
    groups = made.groupBy("look", "exact").agg(F.min("doc_id").alias("_least")).groupBy("look").agg(F.min("_least").alias("group_id"), F.count(F.lit(1)).alias("variants"))
    named = made.join(groups, "look").groupBy("doc_id").agg(F.min(F.struct("group_id", "variants")).alias("_g")).select("doc_id", "_g.group_id", "_g.variants")
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id")).join(named, "doc_id", "left")


class _Forms:
    """Texts to their skeletons, composed again."""

    def __init__(self, letters: tuple[tuple[str, str], ...]):
        self.letters = letters

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            forms = [None if t is None else unicodedata.normalize("NFC", skeleton(t, self.letters)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forms, pa.string())], ["doc_id", "form"])


def consistent_forms(documents: DataFrame) -> DataFrame:
    """``doc_id, form``: each text's skeleton, composed again for reading; null stays null, empty stays empty."""
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_Forms(letter_prototypes()), "doc_id bigint, form string")
