"""Byte-level BPE encoding and decoding, with tree concatenation for long unsplit text.

A short text is encoded by its own task. A long one, as a whole and without being cut into words first, is
halved until its parts (leaves) are short; leaves are rows of their own that tasks encode in parallel.
Going up the tree of halves, every join is mended: a window of pieces around it is encoded anew, and
grows until its first piece is the one that the left side has there and one of its ends is an end that
the right side has too. From there on both sides stand as they are.

Why this is exact: the vocabulary's pattern looks only ahead, and at most one character beyond a
piece and the two of a contraction, so pieces that end two characters or more before the left side's
end are those of the joined text; and a piece that begins where a piece of the right side begins is
followed by just the right side's pieces. A piece longer than ``PIECE`` bytes (text that the pattern
does not split) is encoded by halves in the same way on tokens: a token sequence is the BPE encoding
of its bytes if and only if each pair of neighbouring tokens is the encoding of the pair's bytes, so a
window of tokens around the join is encoded anew until its first and last token are those that stand
there already.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemoflow.llm.scratch import materialize, small_batches
from mnemoflow.llm.textkit import tidied

#: Characters of a leaf at most; bytes of a piece that is encoded at once; pieces in a task's memory; tokens or pieces on each side of a join to begin with.
LEAF, PIECE, MEMORY, WINDOW = 16_384, 2048, 100_000, 4


def joined_tokens(left: list[int], right: list[int], encode: Callable[[bytes], list[int]], spell: Callable[[int], bytes]) -> list[int]:
    """The encoding of both sides' bytes together as one piece, from the encodings of the sides."""
    if not left or not right:
        return left + right
    size = WINDOW
    while True:
        i, j = max(0, len(left) - size), min(len(right), size)
        new = encode(b"".join(map(spell, left[i:])) + b"".join(map(spell, right[:j])))
        if (i == 0 or new[0] == left[i]) and (j == len(right) or new[-1] == right[j - 1]):
            return left[:i] + new + right[j:]
        size *= 2


def encode_tree(piece: bytes, encode: Callable[[bytes], list[int]], spell: Callable[[int], bytes], leaf: int = PIECE) -> list[int]:
    """The BPE encoding of one unsplit piece by halves."""
    parts = [piece]
    while len(parts[0]) > leaf:
        parts = [half for p in parts for half in (p[: len(p) // 2], p[len(p) // 2 :])]
    found = list(map(encode, parts))
    while len(found) > 1:
        found = [joined_tokens(found[i], found[i + 1], encode, spell) for i in range(0, len(found), 2)]
    return found[0]


@dataclass
class Encoded:
    """Tokens of a text and how many of them each piece has; leaves under it and joins whose window changed something."""

    ids: list[int] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    leaves: int = 1
    mended: int = 0


class Codec:
    """A byte-level BPE of a tokenizers file whose pre-tokenizer is the usual byte-level one."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {c: b for b, c in enumerate(_byte_chars())}
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.words = {i: t for t, i in ranks.items()} | {i: t.encode() for t, i in added.items()}
        self.added = added
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pieces = regex.compile(pattern).findall
        self.raw = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.known: dict[str, list[int]] = {}

    def _piece(self, piece: str) -> list[int]:
        data = piece.encode()
        if len(data) > PIECE:
            return encode_tree(data, self.raw, self.words.__getitem__)
        found = self.raw(data)
        if len(data) <= 64:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[piece] = found
        return found

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, piece = self.known, self._piece
        for k, part in enumerate(self.split_added.split(text) if self.split_added else [text]):
            if k % 2:
                out.append(self.added[part])
            else:
                for p in self.pieces(part):
                    out += known.get(p) or piece(p)
        return out

    def encode_pieces(self, text: str, sides: tuple[list[int], list[int]] | None = None) -> Encoded:
        """Like ``encode``, with the tokens of each piece counted. sides: the text's tokens as two sides have them; a long piece that is made of their pieces alone is joined from those."""
        out, at, ends = Encoded(), 0, {0: 0}
        if sides:
            for place, n in zip(np.cumsum([len(self.words[i]) for i in sides[0]]).tolist(), np.cumsum([1] * len(sides[0])).tolist(), strict=True):
                ends[place] = n
        for k, part in enumerate(self.split_added.split(text) if self.split_added else [text]):
            for p in [part] if k % 2 else self.pieces(part):
                size = len(p.encode())
                if k % 2:
                    own = [self.added[p]]
                elif size > PIECE and sides and at in ends and at + size in ends and any(ends[at] < x < ends[at + size] for x in sides[1]):
                    cuts = [ends[at], *(x for x in sides[1] if ends[at] < x < ends[at + size]), ends[at + size]]
                    own = []
                    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                        own = joined_tokens(own, sides[0][i:j], self.raw, self.words.__getitem__)
                else:
                    own = self.known.get(p) or self._piece(p)
                at += size
                out.ids += own
                out.counts.append(len(own))
        return out

    def join(self, left: Encoded, right: Encoded) -> Encoded:
        """The encoding of both sides' texts together."""
        leaves, mended = left.leaves + right.leaves, left.mended + right.mended
        if not left.counts or not right.counts:
            return Encoded(left.ids + right.ids, left.counts + right.counts, leaves, mended)
        size = WINDOW
        while True:
            i, j = max(0, len(left.counts) - size), min(len(right.counts), size)
            own = left.counts[i:] + right.counts[:j]
            tail, head = sum(left.counts[i:]), sum(right.counts[:j])
            ids = left.ids[len(left.ids) - tail :] + right.ids[:head]
            places = np.cumsum([0, *own]).tolist()
            data = b"".join(map(self.words.__getitem__, ids))
            new = self.encode_pieces(data.decode(), (ids, places))
            spelled = np.cumsum([0, *(len(self.words[x]) for x in ids)])
            # Byte places where pieces of the right side begin, and how many of its pieces come before each.
            begins = {int(spelled[tail + n]): k for k, n in enumerate(np.cumsum([0, *right.counts[:j]]).tolist())}
            again = np.cumsum([0, *(len(self.words[x]) for x in new.ids)])
            if i == 0 or new.ids[: new.counts[0]] == left.ids[len(left.ids) - tail :][: left.counts[i]]:
                tokens = 0
                for k, n in enumerate(new.counts):
                    tokens += n
                    end = int(again[tokens])
                    if end in begins and (j == len(right.counts) and end == len(data) or len(data[end : end + 16].decode("utf-8", "ignore")) >= 2):
                        r = begins[end]
                        used = sum(right.counts[:r])
                        changed = new.counts[: k + 1] != left.counts[i:] + right.counts[:r] or new.ids[:tokens] != ids[: tail + used]
                        return Encoded(left.ids[: len(left.ids) - tail] + new.ids[:tokens] + right.ids[used:], left.counts[:i] + new.counts[: k + 1] + right.counts[r:], leaves, mended + changed)
            size *= 2

    def halves(self, text: str, leaf: int) -> list[str]:
        """The text cut in half until no part is longer than a leaf, never inside an added token."""
        parts, cut = [text], True
        while cut:
            cut, new = False, []
            for p in parts:
                at = len(p) // 2
                for token in self.added:
                    place = p.find(token, max(0, at - len(token) + 1), at + len(token) - 1)
                    at = place if 0 <= place < at else at
                if len(p) > leaf and 0 < at < len(p):
                    cut = True
                    new += [p[:at], p[at:]]
                else:
                    new.append(p)
            parts = new
        return parts

    def concatenated(self, leaves: list[Encoded]) -> Encoded:
        """The leaves' texts together, joined pair by pair up the tree."""
        while len(leaves) > 1:
            leaves = [self.join(leaves[i], leaves[i + 1]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
        return leaves[0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.words.__getitem__, ids)).decode("utf-8", "replace")


def _byte_chars() -> str:
    """The characters that stand for bytes 0 to 255 in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(others)) for b in range(256))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def default_vocabulary() -> tuple[str, str]:
    """File and pattern of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def bpe(docs: DataFrame, path: str | None = None, pattern: str | None = None, digests: bool = False, leaf: int = LEAF) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    docs: doc_id and text; other columns are not read. Returns doc_id, n_tokens and ids (array of int)
    and decoded (string), or with ``digests`` ids_sha256 and decoded_sha256 instead; and n_leaves, the
    parts that the text was encoded in, and n_mended, the joins of them where tokens had to change.

    Null and empty texts have no tokens. Added tokens that stand in a text become their own id, as in
    the library. Rows with null or repeated doc_id are encoded like others; an empty table gives no
    rows. The path must be readable where the executors run. Texts longer than ``leaf`` characters are
    written to the shared folder and encoded leaf by leaf in all tasks; one task then joins a text.
    """
    own = default_vocabulary() if path is None or pattern is None else ("", "")
    path, pattern = path or own[0], pattern or own[1]
    names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]), "n_leaves", "n_mended"]
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string") + ", n_leaves long, n_mended long"
    kinds = [pa.int64(), pa.int64(), pa.string() if digests else pa.list_(pa.int32()), pa.string(), pa.int64(), pa.int64()]

    def shown(c: Codec, doc_id: int | None, found: Encoded) -> tuple:
        text = c.decode(found.ids)
        if digests:
            return doc_id, len(found.ids), hashlib.sha256(",".join(map(str, found.ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), found.leaves, found.mended
        return doc_id, len(found.ids), found.ids, text, found.leaves, found.mended

    def table(rows: list[tuple]) -> list[pa.Array]:
        return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for i in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays(table([shown(c, d.as_py(), Encoded(c.encode(x.as_py() or ""))) for d, x in zip(part.column(0), part.column(1), strict=True)]), names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for row, d, x in zip(*batch.columns, strict=True):
                parts = c.halves(x.as_py(), leaf)
                yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(parts), pa.int64()), pa.array([d.as_py()] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], ["row", "doc_id", "leaf", "text"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for i in range(0, max(1, batch.num_rows), 64):
                part = batch.slice(i, 64)
                found = [c.encode_pieces(x.as_py()) for x in part.column(3)]
                packed = [pa.array([np.array(v, np.uint32).tobytes() for v in column], pa.binary()) for column in ([f.ids for f in found], [f.counts for f in found])]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), *packed], ["row", "doc_id", "leaf", "ids", "counts"])

    def concatenate(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        c, rows = codec(path, pattern), rows.sort_by("leaf")
        parts = [Encoded(*(np.frombuffer(x, np.uint32).tolist() for x in r)) for r in zip(rows["ids"].to_pylist(), rows["counts"].to_pylist(), strict=True)]
        return pa.table(table([shown(c, rows["doc_id"][0].as_py(), c.concatenated(parts))]), names)

    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = F.coalesce(F.length("text") > leaf, F.lit(False))
    short = docs.where(~long).mapInArrow(tidied(whole), schema)
    # Rows are numbered in the written table, so that a lost executor's part gets the same numbers again.
    texts = materialize(docs.where(long).withColumn("row", F.monotonically_increasing_id()), "long_texts").select("row", "doc_id", "text")
    parts = texts.mapInArrow(tidied(cut), "row long, doc_id long, leaf int, text string").repartition("row", "leaf")
    encoded = parts.mapInArrow(tidied(leaves), "row long, doc_id long, leaf int, ids binary, counts binary")
    return short.union(encoded.groupBy("row").applyInArrow(concatenate, schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)


ORACLE_SQL = None
