"""Line deduplication by a deletion-neighbourhood join.

Two lines are alike if their words are equal, or if one inserted, deleted or
replaced unit turns one into the other. The units of a line are its words, if it
has at least ``edit_units``, else its characters (words joined by a blank), if
these are as many; lines with fewer characters are alike only if equal. So one
unit in ten may differ, in a footer line as in a paragraph. All variants of a line
with one unit deleted are emitted as hashed keys and equal keys are joined; a key
names the place of the deleted unit, so that lines with the same key are within
the bound. Candidates are verified on their units, and the earliest line stays.

A line of n units has n variants, so lines without any partner leave first:
variants with a whole half, then a whole eighth, deleted find the lines, and
then the parts of them, in which another line differs.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (KEY, id_type, keyed, map_batches, release, rewritten, rows_with_keys, slices,
                     stored, with_row)

#: Least units of a line of which one may differ: a similarity of 0.9.
EDIT_UNITS = 10
#: Parts of a line that are deleted whole, in the rounds before single words.
HALVES, EIGHTHS = 2, 8


def signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def words_of(line: bytes) -> list[bytes]:
    return line.split()


def units_of(line: bytes, edit_units: int) -> list[bytes]:
    """What may be edited: the words of a line, or the characters of one with
    too few words; none of one with too few characters. A character is marked by
    a tab, which no word holds, so the two kinds never meet."""
    words = line.split()
    if len(words) >= edit_units:
        return words
    characters = b" ".join(words).decode()
    return [b"\t" + c.encode() for c in characters] if len(characters) >= edit_units else []


def part_keys(words: list[bytes], parts: int) -> list[tuple[int, int]]:
    """(key, place) of the variants with one of ``parts`` parts deleted. Parts
    are laid out for ``m`` words, the shorter length of a pair: this line's own
    or one less; the end is counted from the end, so an inserted word in the
    part changes nothing outside it."""
    n, found = len(words), []
    for longer, m in enumerate((n, n - 1)):
        for part in range(parts):
            start, rest = part * m // parts, m - (part + 1) * m // parts
            kept = b" ".join(words[:start]) + b"\n" + b" ".join(words[n - rest:] if rest else [])
            found.append((signed(xxhash.xxh3_64_intdigest(kept, (m * parts + part) & 0xFFFFFFFF)),
                          longer * parts + part))
    return found


#: Kinds of word variants: a replaced word; the longer line without a word;
#: the shorter line as it is.
REPLACED, LONGER, SHORTER = 0, 1, 2


def word_keys(words: list[bytes], places: list[int], parts: int) -> list[tuple[int, int]]:
    """(key, kind) of the variants with one word deleted, in the given parts."""
    n, found = len(words), {}

    def without(at: int) -> bytes:
        return b" ".join(words[:at] + words[at + 1:])

    for place in places:
        longer, part = divmod(place, parts)
        m = n - longer
        start, stop = part * m // parts, (part + 1) * m // parts
        if longer:
            for at in range(start, min(stop, n - 1) + 1):
                found[signed(xxhash.xxh3_64_intdigest(without(at), 1)), LONGER] = None
        else:
            for at in range(start, stop):
                found[signed(xxhash.xxh3_64_intdigest(without(at), 2 + at)), REPLACED] = None
            found[signed(xxhash.xxh3_64_intdigest(b" ".join(words), 1)), SHORTER] = None
    return list(found)


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the edit distance of two word lists is at most one."""
    if abs(len(a) - len(b)) > 1:
        return False
    least, same = min(len(a), len(b)), 0
    while same < least and a[same] == b[same]:
        same += 1
    tail = 0
    while tail < least - same and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return max(len(a), len(b)) - same - tail <= 1


def all_lines(docs: DataFrame, kind: str, edit_units: int) -> DataFrame:
    """One row per line with words: its place, 128-bit hash, and the keys of
    the variants without a half."""
    def work(batches):
        for batch in slices(batches, max_bytes=1 << 20):
            out: dict[str, list] = {c: [] for c in ("doc_id", "k1", "k2", "line", "h1", "h2", "keys")}
            for doc, k1, k2, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "k1", "k2", "text"))):
                for number, line in enumerate(text.encode().split(b"\n")):
                    words = words_of(line)
                    if not words:
                        continue
                    digest = xxhash.xxh3_128_intdigest(b" ".join(words))
                    units = words if len(words) >= edit_units else units_of(line, edit_units)
                    for c, v in zip(out, (doc, k1, k2, number, signed(digest >> 64), signed(digest & (1 << 64) - 1),
                                          [k for k, _ in part_keys(units, HALVES)] if units else None)):
                        out[c].append(v)
            yield out

    return map_batches(docs, work, f"doc_id {kind}, {KEY}, line long, h1 long, h2 long, keys array<long>")


def shared_keys(keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` (key, ...) whose key another line has as well. A
    line has a key at most once, so counting rows counts lines."""
    again = keys.groupBy("key").count().where("count > 1").select("key")
    return keys.join(again, "key")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted lines (pos), from their documents."""
    numbers = wanted.groupBy("pos.k1", "pos.k2").agg(F.collect_list("pos").alias("places"))
    joined = docs.select("k1", "k2", "text").join(numbers, ["k1", "k2"]).select("text", "places")
    place = wanted.schema["pos"].dataType.simpleString()

    def work(batches):
        for batch in slices(batches, max_bytes=1 << 20):
            places, found = [], []
            for text, some in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
                lines = text.encode().split(b"\n")
                places += some
                found += [b" ".join(words_of(lines[p["line"]])) for p in some]
            yield {"pos": places, "words": found}

    return map_batches(joined, work, f"pos {place}, words binary").dropDuplicates(["pos"])


def near_pairs(docs: DataFrame, distinct: DataFrame, edit_units: int) -> DataFrame:
    """(pos, earlier): first places of distinct lines that an earlier line is
    within one unit of."""
    place = distinct.schema["pos"].dataType.simpleString()
    halves = distinct.where("keys IS NOT NULL").select("pos", F.explode(F.array_distinct("keys")).alias("key"))
    wanted = shared_keys(halves).select("pos").distinct()
    lines = stored(texts_of(docs, wanted), "lines")

    def eighths(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                places, keys, parts = [], [], []
                for pos, words in zip(some.column("pos").to_pylist(), some.column("words").to_pylist()):
                    for key, part in part_keys(units_of(words, edit_units), EIGHTHS):
                        places.append(pos), keys.append(key), parts.append(part)
                yield {"pos": places, "key": keys, "part": parts}

    parts = shared_keys(map_batches(lines, eighths, f"pos {place}, key long, part int"))
    parts = parts.groupBy("pos").agg(F.collect_set("part").alias("parts"))  # at most 2 * EIGHTHS

    def single(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                places, keys, kinds = [], [], []
                for pos, words, parts in zip(*(some.column(c).to_pylist() for c in ("pos", "words", "parts"))):
                    for key, kind in word_keys(units_of(words, edit_units), parts, EIGHTHS):
                        places.append(pos), keys.append(key), kinds.append(kind)
                yield {"pos": places, "key": keys, "kind": kinds}

    variants = stored(map_batches(lines.join(parts, "pos"), single, f"pos {place}, key long, kind int"), "variants")
    # Only the earliest line of each kind is needed, so a group is never gathered.
    firsts = variants.groupBy("key").agg(*(F.min(F.when(F.col("kind") == k, F.col("pos"))).alias(f"first{k}")
                                           for k in (REPLACED, LONGER, SHORTER)), F.count("*").alias("n"))
    partner = (F.when(F.col("kind") == REPLACED, F.col(f"first{REPLACED}"))
               .when(F.col("kind") == LONGER, F.col(f"first{SHORTER}")).otherwise(F.col(f"first{LONGER}")))
    pairs = (variants.join(firsts.where("n > 1"), "key").select("pos", partner.alias("earlier"))
             .where("earlier < pos").distinct())
    both = (pairs.join(lines, "pos")
            .join(lines.select(F.col("pos").alias("earlier"), F.col("words").alias("earlier_words")), "earlier"))

    def verify(batches):
        import pyarrow as pa
        for batch in batches:
            good = [within_one(units_of(a, edit_units), units_of(b, edit_units)) for a, b in zip(
                batch.column("words").to_pylist(), batch.column("earlier_words").to_pylist())]
            yield dict(zip(("pos", "earlier"), (batch.column(c).filter(pa.array(good, pa.bool_()))
                                                for c in ("pos", "earlier"))))

    out = stored(map_batches(both, verify, f"pos {place}, earlier {place}"), "pairs")
    release(lines, variants)
    return out


def removed_lines(df: DataFrame, edit_units: int, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, lines): numbers of the lines that an earlier line is alike."""
    docs = keyed(df, id_col, text_col)
    lines = stored(all_lines(docs, id_type(df, id_col), edit_units), "all-lines")
    distinct = stored(lines.groupBy("h1", "h2").agg(
        F.min(F.struct("doc_id", "k1", "k2", "line")).alias("pos"), F.first("keys").alias("keys"),
        F.count("*").alias("n")), "distinct-lines")
    copies = (lines.join(distinct.where("n > 1").select("h1", "h2", "pos"), ["h1", "h2"])
              .where("k1 <> pos.k1 OR k2 <> pos.k2 OR line <> pos.line").select("k1", "k2", "line"))
    near = near_pairs(docs, distinct, edit_units).select("pos.k1", "pos.k2", "pos.line")
    gone = stored(copies.unionByName(near), "gone-lines")
    release(lines, distinct)
    # A document's own line numbers: bounded by its length.
    return gone.groupBy("k1", "k2").agg(F.collect_set("line").alias("gone"))


def cut_lines(rows: DataFrame, gone: DataFrame, df: DataFrame) -> DataFrame:
    def work(batches):
        for batch in slices(batches):
            texts, counts, removed = [], [], []
            for text, numbers in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
                lines, drop = text.split("\n"), set(numbers or ())
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text)
                counts.append(len(lines) if text else 0)
                removed.append(len(drop))
            yield {"row": batch.column("row"), "new_text": texts, "n_lines": counts, "n_removed": removed}

    return map_batches(rows.join(gone, ["k1", "k2"], "left").select("row", "text", "gone"), work,
                       with_row(df, "new_text string, n_lines long, n_removed long"))


def line_dedup(df: DataFrame, edit_units: int = EDIT_UNITS, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, kept (text).

    Lines are what ``\\n`` separates; words what bytes 09-0D and 20 separate. A
    line is removed if an earlier line, by (doc_id, line), is alike, whether or
    not that one is removed itself. Lines without words stay. Null text counts
    as empty (no lines). Null ids come first; rows with the same id are ordered
    by a hash of their text; identical rows count as one and lose the same
    lines. A text without a line break is one line, alike another within one
    word, however long it is. Other columns are not read.
    """
    base = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    made = cut_lines(rows_with_keys(base, "doc_id", "text"), removed_lines(df, edit_units, id_col, text_col), base)
    return made.select("row.doc_id", "n_lines", "n_removed", F.col("new_text").alias("kept"))


def without_duplicate_lines(df: DataFrame, edit_units: int = EDIT_UNITS, id_col: str = "doc_id",
                            text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, with the lines cut out of the text. A
    document that loses every line stays, with an empty text."""
    made = cut_lines(rows_with_keys(df, id_col, text_col), removed_lines(df, edit_units, id_col, text_col), df)
    return rewritten(df, made, text_col)
