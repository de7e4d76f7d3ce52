"""Harmonic packing of token sequences.

A piece of n tokens belongs to class k = capacity // n, and a bin of class k takes exactly k pieces: a fixed number, so a
worker fills its own bins of each class without looking at anything else, and nothing is shuffled. Documents may be cut,
so a long one gives whole bins first, and what is left is cut down at the class sizes capacity // k until a short tail is
left; pieces of exactly a class size leave no gap, and only tails can leave one, of less than a tail's length each.
At its end a worker strings the pieces of its unfilled bins together, cutting where a bin is full; the very last bin is
cut at powers of two, which need no padding.

Null text: encoded as the empty text, so its document is the end id alone. Repeated rows and ids are packed once for each
row. An empty table gives no rows. Sequence ids are unique (worker number, then a count); they have gaps between workers.
"""

from __future__ import annotations

import gc
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import texts, trim

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, text_ids binary"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
#: Tails up to this length are not cut further.
TAIL = 64


def cut(n: int, capacity: int, tail: int = TAIL) -> list[int]:
    """Piece lengths for a document of n tokens: whole bins, class sizes, one tail."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n > tail:
        size = capacity // -(-capacity // n)
        out.append(size)
        n -= size
    return out + [n] * (n > 0)


def powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Bins of one worker. Pieces are (what they are of, start, length); an open bin holds only the bytes of its pieces."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}

    def sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        """(document, start, length, sequence_id, offset) for the pieces of one bin."""
        at, sid = 0, self.next_id
        self.next_id += 1
        for doc, start, length in pieces:
            yield doc, start, length, sid, at
            at += length

    def add(self, doc_id: int, ids: bytes) -> Iterator[tuple]:
        start, total = 0, len(ids) // 4
        for length in cut(total, self.capacity):
            k = self.capacity // length
            group = self.open.setdefault(k, [])
            group.append(((doc_id, total, ids[4 * start : 4 * (start + length)], start), start, length))
            start += length
            if len(group) == k:
                del self.open[k]
                yield from self.sequence(group)

    def finish(self) -> Iterator[tuple]:
        """Strings what is left together; only the last bin can stay short, and it is cut at powers of two."""
        left = [p for k in sorted(self.open) for p in self.open.pop(k)]
        total = sum(p[2] for p in left)
        sizes = [self.capacity] * (total // self.capacity) + powers(total % self.capacity)
        left.reverse()
        for size in sizes:
            group = []
            while size:
                doc, start, length = left.pop()
                take = min(size, length)
                group.append((doc, start, take))
                size -= take
                if take < length:
                    left.append((doc, start + take, length - take))
            yield from self.sequence(group)


#: Runs for which lower-casing, NFC and the splitter's classes are plain: ASCII and the letters and signs of Latin-1.
PLAIN = regex.compile(r"[!-~\xa1-\xff]+")
#: Fixed value: the splitter of the vocabulary file, which also keeps what it matches.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class LibraryIds:
    """Little-endian 32-bit ids of whole texts as the tokenizers library gives them.

    The file's normaliser and splitter work on runs between white space alone, and splitting drops white space, so a
    text's ids are those of its runs strung together. Distinct runs are encoded once; a full memo is emptied. Where the
    normaliser is that of `lower_words`, plain runs are lowered and split here, and their distinct pieces go to the
    library's model many at a time; every piece ends in a token that carries the end-of-word mark. All other runs, such as
    those with special strings or rarer scripts, take the library's whole path one by one.
    """

    MOST = 400_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.mark = data["model"].get("end_of_word_suffix")
        self.special = [t["content"] for t in data["added_tokens"]]
        self.simple = bool(self.mark) and lower_words(data)
        if self.simple:
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocab = data["model"]["vocab"]
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for s, i in vocab.items() if s.endswith(self.mark)]] = True

    def whole(self, runs: list[bytes]) -> None:
        for at in range(0, len(runs), 20_000):
            part = runs[at : at + 20_000]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([r.decode() for r in part], add_special_tokens=False)]
            data = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
            ends = [0, *accumulate(4 * len(i) for i in ids)]
            self.memo.update(zip(part, map(data.__getitem__, map(slice, ends, ends[1:]))))

    def learn_pieces(self, new: list[str]) -> bool:
        """Ids of distinct pieces into the memo; False if the marks don't tell them apart."""
        for at in range(0, len(new), 5_000):
            part = new[at : at + 5_000]
            ids = np.array(self.bare.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            if len(ends) != len(part) + 1:
                return False
            data = ids.tobytes()
            self.pieces.update(zip(part, map(data.__getitem__, map(slice, ends, ends[1:]))))
        return True

    def learn(self, runs: list[bytes]) -> None:
        hard, one, several = [], {}, {}
        for r in runs:
            s = r.decode()
            if self.simple and (s.isascii() and s.isprintable() or PLAIN.fullmatch(s)) and not ("<" in s and any(x in s for x in self.special)):
                s = s.lower()
                if s.isalpha():
                    one[r] = s
                else:
                    several[r] = PIECES.findall(s)
            else:
                hard.append(r)
        new = {p for p in chain(one.values(), chain.from_iterable(several.values())) if p not in self.pieces}
        if new and not self.learn_pieces(list(new)):
            return self.whole(runs)
        pieces = self.pieces
        for r, p in one.items():
            self.memo[r] = pieces[p]
        for r, ps in several.items():
            self.memo[r] = b"".join([pieces[p] for p in ps])
        self.whole(hard)

    def of(self, group: list[str]) -> Iterator[bytes]:
        memo = self.memo
        if len(memo) > self.MOST:
            memo.clear()
            self.pieces.clear()
        found, open_, new = [], [], set()
        for text in group:
            data = text.encode()
            # Lowering A-Z here makes fewer distinct runs; special strings are told apart by case, so their texts stay.
            runs = (data.lower() if self.simple and b"<|" not in data else data).split()
            values = list(map(memo.get, runs))
            missing = [i for i, v in enumerate(values) if v is None]
            found.append(values)
            open_.append([(i, runs[i]) for i in missing])
            new.update(runs[i] for i in missing)
        if new:
            self.learn(list(new))
        for values, missing in zip(found, open_):
            for i, r in missing:
                values[i] = memo[r]
            yield b"".join(values)


def lower_words(data: dict) -> bool:
    """Whether a vocabulary file normalises by NFC, white space and lower case, and splits by PIECES."""
    steps = (data["normalizer"] or {}).get("normalizers", [])
    split = (data["pre_tokenizer"] or {}).get("pretokenizers", [{}])
    return [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and split[0].get("pattern") == {"Regex": PIECES.pattern} and [s["type"] for s in split] == ["Split", "ByteLevel"]


@lru_cache(maxsize=2)
def library_ids(path: str) -> LibraryIds:
    """One per worker process: later tasks find the memo filled."""
    ids = LibraryIds(path)
    gc.freeze()  # the vocabulary's objects stay; the collector need not walk them again and again
    return ids


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """SCHEMA: one row per piece; text_ids are its ids as little-endian 32-bit numbers (null unless with_ids)."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from .bpe import chunks

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        encoder = library_ids(vocabulary)
        packer = Packer(capacity, TaskContext.get().partitionId() << 33)
        rows: list[tuple] = []

        def put(placed) -> None:
            for (doc_id, total, part, begins), start, length, sid, at in placed:
                part = part[4 * (start - begins) : 4 * (start - begins + length)]
                rows.append((doc_id, start, length, zlib.crc32(part), total, sid, at, part if with_ids else None))

        def out():
            columns = zip(*rows) if rows else [[]] * len(NAMES)
            kinds = [pa.int64()] * 7 + [pa.binary()]
            b = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], NAMES)
            rows.clear()
            return b

        for b in batches:
            names = iter(b.column("doc_id").to_pylist())
            for group in chunks(b.column("text").to_pylist()):
                for ids in encoder.of(group):
                    put(packer.add(next(names), ids + end))
            yield out()
        put(packer.finish())
        yield out()
        trim()

    return texts(docs).mapInArrow(run, SCHEMA)
