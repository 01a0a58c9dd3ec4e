"""Best-fit packing of tokenised documents into sequences, by the sum-of-squares rule.

A document is its token ids followed by the separator id. Documents longer than a sequence are cut into full pieces,
the first piece taking the rest. A piece goes to the open bin whose choice makes the sum over residual gaps of the
squared number of open bins with that gap smallest; opening a new bin is one of the choices.

Pieces are dealt by hash into groups of bounded size, each packed by one task from long to short. Bins that are not
full enough are dissolved and their pieces packed again in fewer groups of the same size, until one group remains or a
level saves less than ``GAIN`` of the bins it unpacked, as when most pieces fit with no other. Groups depend on rows only: a lost task gives the same bins again.

Null texts are empty: one piece of one token. Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import saved

SIZE = 2048  # tokens of a sequence
END = 0  # id after each document
GROUP = 20_000  # pieces packed by one task on average
LOOSE = 4  # bins with a larger gap are packed again
GAIN = 0.02  # of the bins unpacked that a further level must save
LEVELS = 128  # the level has seven bits in a sequence's identifier
CACHE = 300_000  # distinct words whose ids a task keeps
# fixed values: the word split of byte-level tokenizers over the characters of Latin-1, and over all of Unicode
LETTER, DIGIT, BLANK = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
WIDE_BLANK = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPLIT = " ?[{l}]+| ?[{n}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+"


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    A byte-level tokenizer splits a text into words by a fixed pattern and merges each word by itself. The same split
    is made here, ids of words seen before are reused, and new words are merged by the ranks in the tokenizer's own
    file. Texts that hold a special token's string, and tokenizers of another kind, go through the tokenizer whole.
    """

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that such vocabularies show as themselves
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        vocab = {w: i for w, i in model.get("vocab", {}).items() if w not in self.special}
        plain = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not spec.get("normalizer") and model.get("type") == "BPE" and len(vocab) == 256 + len(pairs)
            and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs))
        )
        self.known: dict[bytes | str, bytes] = {}
        self.narrow = self.wide = None
        if plain:
            wide = SPLIT.format(l=r"\p{L}", n=r"\p{N}", s=WIDE_BLANK)
            ranks = {bytes(byte[c] for c in w): i for w, i in vocab.items()}
            self.merge = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.narrow = re.compile(SPLIT.format(l=LETTER, n=DIGIT, s=BLANK).encode("latin-1")).findall
            self.wide = regex.compile(wide).findall

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.narrow is None or any(s in text for s in self.special):
            return self.whole(text)
        try:
            words: list = self.narrow(text.encode("latin-1"))
        except UnicodeEncodeError:
            words = self.wide(text)
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for w in set(words).difference(known):
            known[w] = array("I", self.merge(w if isinstance(w, str) else w.decode("latin-1"))).tobytes()
        return b"".join(map(known.__getitem__, words))


_encoders: dict[str, Encoder] = {}  # one per Python worker and file: words stay known from task to task


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    first = n % size or min(n, size)
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def pieces(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", size: int = SIZE, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece."""
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("t")):
                b = memoryview(enc.ids(t.as_py() or "") + tail)
                rows += [(i, k, s, n, zlib.crc32(b[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cuts(len(b) // 4, size))]
            cols = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return base.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece in the given order, and the gap left in each bin."""
    count = np.zeros(size + 1, "i8")  # open bins by gap; a full bin is not open
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    gaps: list[int] = []
    bins, offs = np.empty(len(lengths), "i8"), np.empty(len(lengths), "i8")
    far = np.iinfo("i8").max
    for i, s in enumerate(lengths.tolist()):
        new = 2 * count[size - s] + 1 if s < size else 0
        best, pick = new, -1
        c = count[s:]
        if s < size and c.any():
            # change of the sum when a bin of gap g becomes one of gap g - s
            change = np.where(c > 0, 2 * count[: size - s + 1] - 2 * c + 2, far)
            if c[0] > 0:
                change[0] = 1 - 2 * c[0]
            g = int(change.argmin())
            if change[g] <= best:
                pick = g + s
        if pick < 0:
            gap, b = size, len(gaps)
            gaps.append(size)
        else:
            gap, b = pick, stacks[pick].pop()
            count[pick] -= 1
        bins[i], offs[i] = b, size - gap
        gaps[b] = gap - s
        if gap > s:
            stacks[gap - s].append(b)
            count[gap - s] += 1
    return bins, offs, np.array(gaps, "i8")


def packer(level: int, size: int, loose: int | None):
    """Packs one group; pieces of bins with more than ``loose`` free tokens are marked to be packed again."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        bins, offs, gaps = sum_of_squares(pdf["length"].to_numpy(), size)
        pdf["sequence_id"] = (level << 56) + (int(pdf["g"].iloc[0]) << 24) + bins
        pdf["offset"] = offs
        pdf["again"] = False if loose is None else gaps[bins] > loose
        return pdf.drop(columns="g")

    return run


def pack(rows: DataFrame, size: int = SIZE, group: int = GROUP, loose: int = LOOSE) -> DataFrame:
    """Adds sequence_id and offset to pieces (columns of :func:`pieces`).

    Groups keep their size on every level. A level that saves less than ``GAIN`` of the bins it unpacked is the last.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, again boolean"
    todo, done, before, level = rows, None, None, 0
    n = rows.count()
    while True:
        groups = max(1, -(-n // group))
        last = groups == 1

        dealt = todo.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), F.lit(groups)))
        out = saved(dealt.groupBy("g").applyInPandas(packer(level, size, None if last else loose), schema), "packed")
        if before is not None:
            bins, unpacked = out.select("sequence_id").distinct().count(), before.select("sequence_id").distinct().count()
            if bins >= unpacked:
                return done.unionByName(before.drop("again"))
            last = last or bins > (1 - GAIN) * unpacked or level == LEVELS - 1
        final = (out if last else out.where(~F.col("again"))).drop("again")
        done = final if done is None else done.unionByName(final)
        if last:
            return done
        before = out.where("again")
        todo = before.select(*rows.columns)
        n, level = todo.count(), level + 1


def pack_documents(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", size: int = SIZE, end: int = END) -> DataFrame:
    """Pieces of all documents with their sequence and place in it."""
    return pack(saved(pieces(docs, path, text, doc_id, size, end), "pieces"), size)
