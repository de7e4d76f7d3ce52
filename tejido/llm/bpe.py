"""Byte-level BPE by last-token states.

For the merge list of a byte pair encoding, the encoding of a prefix ends in exactly one token t, and what stands before t
is the encoding of the shorter prefix. So a prefix's encoding is held by its last token alone, and the last token of the
next longer prefix is the only vocabulary token t ending there that may stand beside the last token of the prefix before t:
no merge across their seam would have come earlier than the merges that built them.

`Merges` answers that seam question. `Trie` propagates last tokens depth first over a trie of distinct words, so that
shared prefixes are worked out once. `Counter` keeps the token count of every prefix of every word, `Table` those of one text.
"""

from __future__ import annotations

import gc
import json
from array import array
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import regex

#: Unicode White_Space, and the published word pattern of this tokenizer family.
WHITE = "\t-\r \x85\xa0  -     　"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Distinct strings whose result a worker keeps; a full memo is emptied, which costs time only.
MEMO = 500_000


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes: visible Latin-1 stands for itself, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Merges:
    """Vocabulary and merge list of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.check(data)
        symbols = byte_symbols()
        as_bytes = lambda s: bytes(symbols[c] for c in s)
        model = data["model"]
        self.ids = {as_bytes(s): i for s, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.table: dict[int, bytes] = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        #: pair of ids -> when it merges; id -> when and of what it was made
        self.when: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (as_bytes(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            left, right, whole = self.ids[a], self.ids[b], self.ids[a + b]
            self.when.setdefault((left, right), rank)
            self.made.setdefault(whole, (rank, left, right))
        self.beside = lru_cache(maxsize=1 << 18)(self._beside)
        #: A token that its own bytes are not encoded as never ends a prefix; alone() needs its two parts' answers first.
        self.sound: set[int] = {i for i in self.ids.values() if i not in self.made}
        for t, (rank, left, right) in sorted(self.made.items(), key=lambda x: x[1][0]):
            if left in self.sound and right in self.sound and self._beside(left, right, rank):
                self.sound.add(t)
        self.ends = {b: i for b, i in self.ids.items() if i in self.sound}
        self.length = {i: len(b) for i, b in self.table.items()}
        self.longest = max(map(len, self.ends))
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    @staticmethod
    def check(data: dict) -> None:
        m, pre = data["model"], data["pre_tokenizer"] or {}
        if m["type"] != "BPE" or m["dropout"] or m["ignore_merges"] or m["byte_fallback"] or m["end_of_word_suffix"] or data["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
            raise ValueError("only plain byte-level BPE files are supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in data["added_tokens"]):
            raise ValueError("added tokens with stripping or word bounds are not supported")

    def _beside(self, a: int, b: int, until: int | None = None) -> bool:
        """Whether a, b stay apart when the bytes of both are encoded together (or until the merge of that rank).

        The seam is replayed backwards: the merge that came last on either side is undone, which gives the pair that stood
        at the seam until then. Such a pair must not have merged before; at equal rank the leftmost pair merges first, so a
        seam pair wins against a merge on its right and loses against one on its left.
        """
        when, made = self.when, self.made
        if until is None:
            until = len(when)
        elif (r := when[a, b]) < until:
            return False
        first, right_undone = until, False
        while True:
            r = when.get((a, b))
            if r is not None and (r < first or r == first and right_undone):
                return False
            x, y = made.get(a), made.get(b)
            if x is None and y is None:
                return True
            if y is None or x is not None and x[0] > y[0]:
                first, a, right_undone = x[0], x[2], False
            else:
                first, b, right_undone = y[0], y[1], True

    def step(self, path: bytes, last: list[int | None], d: int) -> int:
        """Last token of path[:d], given those of the shorter prefixes (last[0]: none). The likeliest places come first."""
        ends, beside = self.ends, self.beside
        low = max(0, d - self.longest)
        if d > 1:
            at = d - 1 - self.length[last[d - 1]]
            if at >= low and (t := ends.get(path[at:d])) is not None and (at == 0 or beside(last[at], t)):
                return t
        for at in range(d - 1, low - 1, -1):
            t = ends.get(path[at:d])
            if t is not None and (at == 0 or beside(last[at], t)):
                return t
        raise ValueError("no token ends here")

    def prefixes(self, word: bytes) -> list[int | None]:
        """The last token of every prefix; entry 0 is None."""
        last: list[int | None] = [None]
        for d in range(1, len(word) + 1):
            last.append(self.step(word, last, d))
        return last

    def back(self, word_length: int, last: list[int | None]) -> tuple[int, ...]:
        out, d = [], word_length
        while d:
            t = last[d]
            out.append(t)
            d -= self.length[t]
        return tuple(reversed(out))

    def parts(self, text: str) -> list[tuple[str, int | None]]:
        """Text cut at special strings: (piece, special id or None)."""
        if self.split_special is None or "<" not in text:
            return [(text, None)]
        return [(p, self.special.get(p)) for p in self.split_special.split(text) if p]

    def decode(self, ids) -> str:
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace")


class Trie:
    """Distinct words with one last-token state for each node, however many words pass through it.

    Words are kept sorted, and a node is a prefix: a word's nodes up to the prefix that it shares with the word before it
    are already there. A depth-first walk is then one scan with the states of the current path on a stack.
    """

    def __init__(self, merges: Merges, words):
        self.merges = merges
        self.words = sorted(words)

    def walk(self):
        """(word, last-token states of its path, depth that was already there), depth first."""
        step, before, last = self.merges.step, b"", [None]
        for word in self.words:
            shared = 0
            for x, y in zip(word, before):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            for d in range(shared + 1, len(word) + 1):
                last.append(step(word, last, d))
            yield word, last, shared
            before = word

    def encodings(self):
        """(word, ids) for every word."""
        back = self.merges.back
        for word, last, _ in self.walk():
            yield word, back(len(word), last)


#: A segment is a run of white space with what follows it up to the next white space: no word of WORDS crosses its bounds.
SEGMENT = regex.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: The pattern's \\s is Unicode White_Space, without the separators U+001C..U+001F that Python counts in.
WORD = regex.compile(WORDS.replace(r"\s", f"[{WHITE}]").replace(rf"[^[{WHITE}]\p{{L}}\p{{N}}]", rf"[^{WHITE}\p{{L}}\p{{N}}]").replace(r"\S", f"[^{WHITE}]"))


#: Characters of text whose new words are learned together.
CHUNK = 2_000_000


def chunks(texts):
    """Lists of texts of about CHUNK characters."""
    group, n = [], 0
    for t in texts:
        group.append(t)
        n += len(t)
        if n >= CHUNK:
            yield group
            group, n = [], 0
    if group:
        yield group


class Memo:
    """Results by segment; `learn` fills in what is new. A full memo is emptied between chunks, which costs time only."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.segments: dict = {}
        self.words: dict = {}

    def cut(self, texts: list[str]) -> list[list]:
        """Per text its segments (strings) and special ids (numbers), all segments learned."""
        out = []
        for text in texts:
            parts = self.merges.parts(text)
            out.append(SEGMENT.findall(text) if len(parts) == 1 and parts[0][1] is None else [x for p, i in parts for x in ([i] if i is not None else SEGMENT.findall(p))])
        if len(self.segments) > MEMO:
            self.segments.clear()
        if len(self.words) > MEMO // 2:
            self.words.clear()
        new = {s for segs in out for s in segs if s not in self.segments and isinstance(s, str)}
        cut = {s: WORD.findall(s) for s in new}
        known = self.words
        self.learn({w for ws in (*cut.values(), self.besides(new)) for w in ws if w not in known})
        for s, ws in cut.items():
            self.segments[s] = self.finished([self.words[w] for w in ws])
        for i in self.merges.special.values():
            self.segments[i] = self.finished([self.of_special(i)])
        return out


    def besides(self, segments: set[str]) -> set[str]:
        """What is learned beside the words of new segments."""
        return set()


class Encoder(Memo):
    """Ids of whole texts; new distinct words go through a trie."""

    def learn(self, words: set[str]) -> None:
        for w, ids in Trie(self.merges, (w.encode() for w in words)).encodings():
            self.words[w.decode()] = ids

    def finished(self, parts: list[tuple[int, ...]]):
        return parts[0] if len(parts) == 1 else tuple(i for p in parts for i in p)

    @staticmethod
    def of_special(i: int) -> tuple[int, ...]:
        return (i,)

    def encode_batch(self, texts):
        """One id list per text, in order."""
        for group in chunks(texts):
            for segs in self.cut(group):
                out: list[int] = []
                for ids in map(self.segments.__getitem__, segs):
                    out += ids
                yield out


class RoundTrip(Encoder):
    """Keeps for each segment its ids in decimal, how many they are, and the bytes that they decode to."""

    def finished(self, parts):
        ids = super().finished(parts)
        return ",".join(map(str, ids)), len(ids), b"".join(map(self.merges.table.__getitem__, ids))

    def round_trips(self, texts):
        """(decimal ids, how many, decoded text) per text."""
        for group in chunks(texts):
            for segs in self.cut(group):
                decimal, n, data = zip(*map(self.segments.__getitem__, segs)) if segs else ((), (), ())
                yield ",".join(decimal), sum(n), b"".join(data).decode("utf-8", "replace")


class Counter(Memo):
    """Token counts of every prefix of every word by the recurrence; sorted new words keep the states of the prefix they share.

    words: per word the counts of its prefixes, by code points. segments: per segment its tokens.
    """

    RUN = regex.compile(f"[{WHITE}]+")

    def finished(self, parts: list) -> int:
        return sum(t[-1] for t in parts)

    @staticmethod
    def of_special(i: int) -> list[int]:
        return [0, 1]

    def besides(self, segments: set[str]) -> set[str]:
        """Runs of white space: a prefix that ends in one has it as one word."""
        return {m.group() for s in segments if (m := self.RUN.match(s))}

    def learn(self, words: set[str]) -> None:
        length, totals = self.merges.length, [0]
        for word, last, shared in Trie(self.merges, (w.encode() for w in words)).walk():
            del totals[shared + 1 :]
            extend(length, last, totals)
            text = word.decode()
            self.words[text] = _kept(totals if len(text) == len(word) else [t for t, b in zip(totals, [*word, 0]) if b & 0xC0 != 0x80])

    def tables(self, texts):
        """One Table per text, in order."""
        for group in chunks(texts):
            for text, segs in zip(group, self.cut(group)):
                yield Table(self, text, segs, list(map(self.segments.__getitem__, segs)))

    def ensure(self, segment: str) -> None:
        """Learns what the memo has not, or no longer."""
        new = {w for w in (*WORD.findall(segment), *self.besides({segment})) if w not in self.words}
        if new:
            self.learn(new)

    def prefixes_of(self, segment: str) -> list[int]:
        """Tokens of every prefix of a segment, put together from those of its words; nothing is encoded."""
        run = self.RUN.match(segment)
        n = run.end() if run else 0
        self.ensure(segment)
        out = list(self.words[run.group()]) if n else [0]
        before = at = 0
        for w in WORD.findall(segment):
            counts = self.words[w]
            end = at + len(w)
            if end > n:
                first = max(n - at, 0) + 1
                out += [before + c for c in counts[first:]]
                if w in FORMS:  # a form cut short is an apostrophe and a letter
                    out[at + 2] = before + 2
            at = end
            before += counts[-1]
        return out


#: Apostrophe forms of more than one letter.
FORMS = ("'re", "'ve", "'ll")


def _kept(totals: list[int]):
    """A list of counts in few bytes."""
    return bytes(totals) if totals[-1] < 200 and max(totals) < 256 else array("I", totals)


class Table:
    """The exact token count of every prefix of a text (in code points), found once by dynamic programming.

    count(i) is the number of tokens of text[:i]; fit(budget) the longest prefix of at most so many tokens. Both read stored
    counts: nothing is encoded again. A segment starts after a non-space or a special string, which no word crosses, so a
    prefix has the tokens of the segments before and those of a prefix of one segment. Within it, a cut changes words in
    three ways only: white space before the cut is one word (its run is stored as a word of its own), an apostrophe form cut
    short is two tokens, and a special string cut short is plain text after the segment before it (stored with the table).
    """

    def __init__(self, counter: Counter, text: str, segments: list, tokens: list[int]):
        self.counter, self.text, self.segments, self.tokens, self.total = counter, text, segments, tokens, sum(tokens)
        self.cut_specials: dict[int, list[int]] = {}
        self.starts = self.totals = None

    def __len__(self) -> int:
        return self.total

    def prepare(self) -> Table:
        """Where each segment starts and the tokens before it; the counts of special strings that are cut short."""
        if self.starts is not None:
            return self
        words = self.counter.merges.table
        lengths = (len(s) if isinstance(s, str) else len(words[s]) for s in self.segments)
        self.starts, self.totals = [0, *accumulate(lengths)], [0, *accumulate(self.tokens)]
        for k, s in enumerate(self.segments):
            if isinstance(s, str):
                continue
            tail = self.segments[k - 1] if k and isinstance(self.segments[k - 1], str) else ""
            joined = tail + words[s].decode()[:-1]
            counts = self.counter.prefixes_of(joined)
            before = self.tokens[k - 1] if tail else 0
            self.cut_specials[k] = [0, *(c - before for c in counts[len(tail) + 1 :]), 1]
        return self

    def within(self, k: int) -> list[int]:
        """Tokens that each prefix of segment k adds."""
        return self.counter.prefixes_of(self.segments[k]) if isinstance(self.segments[k], str) else self.cut_specials[k]

    def count(self, i: int) -> int:
        self.prepare()
        i = min(i, len(self.text))
        if i <= 0:
            return 0
        k = bisect_right(self.starts, i - 1) - 1
        if self.starts[k + 1] == i:
            return self.totals[k + 1]
        return self.totals[k] + self.within(k)[i - self.starts[k]]

    def fit(self, budget: int) -> int:
        """The longest prefix of the text within the budget."""
        self.prepare()
        if self.totals[-1] <= budget:
            return len(self.text)
        # Each segment and each of its prefixes has a token, but a special string that is cut may join what is before it.
        k = bisect_right(self.totals, budget) - 1
        if k + 1 in self.cut_specials and k + 1 < len(self.segments):
            k += 1
        while k >= 0:
            counts = self.within(k)
            left = budget - self.totals[k]
            best = next((j for j in range(len(counts) - 1, 0, -1) if counts[j] <= left), 0)
            if best or left >= 0:
                return self.starts[k] + best
            k -= 1
        return 0


def extend(length: dict[int, int], last: list[int | None], totals: list[int]) -> None:
    """Carries the recurrence count(d) = count(d - length of the last token) + 1 on to the whole word."""
    for d in range(len(totals), len(last)):
        totals.append(totals[d - length[last[d]]] + 1)


def prefix_counts(merges: Merges, text: str) -> Table:
    """The table of one text."""
    counter = Counter(merges)
    return next(iter(counter.tables([text])), Table(counter, "", [], [])).prepare()


_loaded: dict = {}


def in_worker(kind, path: str):
    """One object of a kind for each vocabulary in a worker process, so that later tasks find its memo filled."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = Merges(path) if kind is Merges else kind(in_worker(Merges, path))
        gc.freeze()  # the vocabulary's objects stay; the collector need not walk them again and again
    return _loaded[kind, path]
