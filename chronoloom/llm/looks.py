"""One consistent form for texts that look the same.

A text is left as it is but for its unstable segments. A quick check per character, from the properties that normalisation defines,
says which characters could change: those whose own form is another one (NFC_Quick_Check No, or a look-alike in it), those that may
compose with what precedes them (Maybe), and those that may change places (combining class not 0). Each run of them is taken with
the one character before it, with which it could compose, brought to the canonical form and put back; stable text of any script
passes. Plain ASCII texts, most of a corpus, pass as a whole.

The form: canonical decomposition; invisible format characters are removed; spaces of every sort become a space (tabs and line
ends stay); full-width forms become ASCII; Greek and Cyrillic letters and foreign hyphens become the Latin ones of the same
shape; canonical composition. Case, accents, superscripts and all else that can be seen stay.

Defined results: null stays null, an empty text empty; a text of nothing but spaces or invisible characters counts as blank and
is in no pair; equal texts are not a pair (they don't differ in characters); extra columns are kept by canonical_texts() and
ignored by look_alikes() and look_classes().
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.storage import materialize

# Letters of the same shape (Cyrillic and Greek, then Latin), hyphens of the same shape.
CYRILLIC = ("АВЕЅІЈКМНОРСТУХԌԚԜѴҮӀӔӘаеорсухѕіјһԁԛԝӏѵүӕә", "ABESIJKMHOPCTYXGQWVYIÆƏaeopcyxsijhdqwlvyæə")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿονϲϳ", "ABEZHIKMNOPTYXCJovcj")
OTHER = ("µ", "μ")  # the micro sign is the Greek letter
HYPHENS = "‐‑֊᠆﹣"
#: Format characters that can be seen, or that change the layout.
SEEN = [*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD, *range(0x13430, 0x13440)]


def look_table() -> dict[int, str | None]:
    """What each character becomes after decomposition."""
    table: dict[int, str | None] = {}
    for i in scanned():
        kind = unicodedata.category(chr(i))
        if kind == "Cf" and i not in SEEN:
            table[i] = None
        elif kind == "Zs":
            table[i] = " "
    table[0x034F] = None  # the grapheme joiner, which joins nothing to be seen
    table.update({0xFF01 + k: chr(0x21 + k) for k in range(94)})
    for foreign, latin in (CYRILLIC, GREEK, OTHER):
        table.update(zip(map(ord, foreign), latin, strict=True))
    table.update({ord(c): "-" for c in HYPHENS})
    return table


#: Ranges without canonical decompositions, format characters, spaces or look-alikes: ideographs, Hangul syllables (stable as they are),
#: surrogates and private use.
PLAIN = ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xF900), (0x20000, 0x2F800), (0x2FA20, 0xE0000), (0xE1000, 0x110000))


def scanned() -> Iterator[int]:
    at = 0x80
    for lo, hi in PLAIN:
        yield from range(at, lo)
        at = hi


@lru_cache(maxsize=1)
def stability() -> tuple[dict[int, str | None], re.Pattern]:
    """The look table, and a pattern of the runs of unstable characters."""
    table = look_table()
    second = set()  # what composes with a character before it
    for i in scanned():
        parts = unicodedata.decomposition(chr(i)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            second.add(int(parts[1], 16))
    second |= {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # vowels and final consonants of Hangul
    loose = [i for i in scanned() if i in table or i in second or unicodedata.combining(chr(i)) or form_of(chr(i), table) != chr(i)]
    runs, start = [], 0
    for k in range(1, len(loose) + 1):
        if k == len(loose) or loose[k] != loose[k - 1] + 1:
            runs.append(f"\\U{loose[start]:08x}-\\U{loose[k - 1]:08x}")
            start = k
    unstable = "".join(runs)
    return table, re.compile(f"[{unstable}]+")


def form_of(s: str, table: dict[int, str | None]) -> str:
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", s).translate(table))


class Former:
    """canonical(text); keeps the forms of the segments it has met, up to a bound."""

    def __init__(self, keep: int = 50_000) -> None:
        self.table, self.unstable = stability()
        self.kept, self.keep = {}, keep

    def _form(self, s: str) -> str:
        form = self.kept.get(s)
        if form is None:
            form = form_of(s, self.table)
            if len(s) < 200 and len(self.kept) < self.keep:
                self.kept[s] = form
        return form

    def canonical(self, text: str) -> str:
        if text.isascii():
            return text
        out, last = [], 0
        for m in self.unstable.finditer(text):
            at = max(m.start() - 1, last)  # with the character before, if it is not in the segment before
            out += (text[last:at], self._form(text[at : m.end()]))
            last = m.end()
        return "".join([*out, text[last:]]) if last else text


def canonical_texts(docs: DataFrame, text: str = "text", out: str = "canonical") -> DataFrame:
    """docs with a column of the canonical form of text."""
    full = docs.withColumn(out, F.lit(None).cast("string")).schema
    names = [*docs.columns, *([out] if out not in docs.columns else [])]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        former = Former()
        for b in batches:
            form = pa.array([None if t is None else former.canonical(t) for t in b.column(text).to_pylist()], pa.string())
            cols = {c: b.column(c) for c in b.schema.names} | {out: form}
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names)

    return docs.mapInArrow(kernel, full)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and 128-bit digests of the canonical and of the stored text, for texts that are not blank."""
    former, digest = Former(), xxhash.xxh3_128_digest
    for b in batches:
        ids, look, raw = [], [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            c = former.canonical(t)
            if c and not c.isspace():
                ids.append(i)
                raw.append(digest(t))
                look.append(raw[-1] if c is t else digest(c))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(look, pa.binary()), pa.array(raw, pa.binary())], ["doc_id", "look", "raw"])


def _mixed(docs: DataFrame) -> DataFrame:
    """doc_id, look, raw of the documents whose look comes with several texts; the digests are made once and written."""
    keyed = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(_digests, "doc_id long, look binary, raw binary")
    keyed = materialize(keyed, "looks")
    classes = keyed.groupBy("look", "raw").agg(F.count("*").alias("n"))
    mixed = classes.groupBy("look").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("look")
    return keyed.join(mixed, "look", "left_semi").distinct()


def look_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id that looks the same), kinds (different texts in the class), one row per document that has a
    look-alike."""
    members = _mixed(docs)
    per = members.groupBy("look").agg(F.min("doc_id").alias("class_id"), F.countDistinct("raw").alias("kinds"))
    return members.join(per, "look").select("doc_id", "class_id", "kinds")


def look_alikes(docs: DataFrame) -> DataFrame:
    """doc_a, doc_b: pairs of documents that look the same and differ in characters. Copies are collapsed to classes of one
    stored text first, pairs are made of classes, and only classes that have a partner are opened again."""
    members = _mixed(docs)
    kinds = members.select("look", "raw").distinct()
    pairs = kinds.select("look", F.col("raw").alias("raw_a")).join(kinds.select("look", F.col("raw").alias("raw_b")), "look").filter("raw_a < raw_b").drop("look")
    a, b = members.select(F.col("doc_id").alias("a"), F.col("raw").alias("raw_a")), members.select(F.col("doc_id").alias("b"), F.col("raw").alias("raw_b"))
    return pairs.join(a, "raw_a").join(b, "raw_b").select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"))
