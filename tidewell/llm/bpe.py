"""BPE encoding and decoding with tree concatenation.

Unsplit text (a word, as the tokenizer's pre-tokenizer yields it) is encoded by
a tree: while longer than a leaf it is halved, its halves are encoded, and at
each join a window of tokens is re-encoded, growing until its outer tokens agree
with both sides.  A token sequence in which every neighbouring pair stands as
BPE would leave it is the BPE encoding of its text, so agreement at both ends
makes the join exact.  Each distinct word of a slice of texts is encoded once;
leaves are merged many at a time, in numpy, and the texts' results are put
together from those of their words in Arrow.  Long documents are
cut into pieces that Spark encodes in parallel; their joins re-split growing
windows of text in the same way, until word boundaries agree.  Of the
tokenizers library only the normal form and, beyond code point 0x24F, the
pre-tokenizer are used; no text is encoded by it.  Words of pieces are kept in a
bounded table, since windows hold them again.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from itertools import chain, groupby
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import slices, small_batches, text_buffer

LEAF = 64
#: The rank of a pair that is never merged.
NONE = 1 << 62
LONG_TEXT = 1 << 16
TABLE_ENTRIES = 200_000
#: Bytes of text whose results a worker holds at once.
SLICE_BYTES = 2 << 20
#: A cut text's word boundaries are certain this many characters before the cut (the longest contraction has 3).
MARGIN = 4
SUFFIX = "</w>"
SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")
#: Words whose leaves are merged at a time.
MANY = 8192
SPACE, LETTER, NUMBER, MARK = range(4)


def _simple_pattern() -> tuple[re.Pattern, re.Pattern, np.ndarray]:
    """The pre-tokenizer's pattern for texts of code points below 0x250, a search for any others, and the kind of each such code point.

    Such texts are in composed form already and lower-case a character at a time.
    """
    import unicodedata

    kind = {"L": [], "N": [], "S": []}
    for c in map(chr, range(0x250)):
        if c in "\t\n\v\f\r \x85\xa0":
            kind["S"].append(c)
        elif unicodedata.category(c)[0] in "LN":
            kind[unicodedata.category(c)[0]].append(c)
    text = {k: "".join(map(re.escape, v)) for k, v in kind.items()}
    table = np.full(0x250, MARK, dtype=np.uint8)
    for name, value in (("S", SPACE), ("L", LETTER), ("N", NUMBER)):
        table[list(map(ord, kind[name]))] = value
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{text['L']}]+|[{text['N']}]|[^{text['S']}{text['L']}{text['N']}]+"), re.compile("[^\x00-ɏ]"), table


_SIMPLE, _OTHER, _KIND = _simple_pattern()


def simple_words(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """What _SIMPLE finds in normalised texts of code points below 0x250: the words of all, and where each text's begin (at last, their end)."""
    code = np.frombuffer(("\n".join(texts) + "\n" * 4).encode("utf-16-le"), dtype=np.uint16)
    kind = _KIND[code]
    start = kind != SPACE
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    quote = np.flatnonzero(code == ord("'"))
    quote = quote[kind[quote - 1] != MARK]  # before the first character stands the last, a blank
    a, b = code[quote + 1], code[quote + 2]
    one = np.isin(a, list(map(ord, "stmd")))
    two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
    for found, letters in ((quote[one], 1), (quote[two], 2)):
        for k in range(1, letters + 1):
            start[found + k] = False
        start[found + letters + 1] = kind[found + letters + 1] != SPACE
    begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts], dtype=np.int64)])
    first = np.searchsorted(np.flatnonzero(start), begin)
    inside = kind != SPACE
    code = code[inside]
    end = np.cumsum((code >= 0x80) + np.uint8(1), dtype=np.int32)  # of each character, in bytes
    offsets = np.concatenate([[0], end[np.flatnonzero(start[inside])[1:] - 1], end[-1:]]).astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(code.tobytes().decode("utf-16-le").encode("utf-8"))), first


def joined(texts: pa.StringArray, which: np.ndarray, first: np.ndarray) -> pa.StringArray:
    """For each k, the texts numbered which[first[k] : first[k + 1]] in one."""
    taken = texts.take(pa.array(which))
    _, offsets, data = taken.buffers()
    places = np.frombuffer(offsets, dtype=np.int32, count=len(taken) + 1, offset=4 * taken.offset)[first] if len(taken) else np.zeros(len(first), dtype=np.int32)
    return pa.StringArray.from_buffers(len(first) - 1, pa.py_buffer(places), data if len(taken) else pa.py_buffer(b""))


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or 256 and up."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


class Piece(NamedTuple):
    """A part of a text: its normalised text; each word's place in it and number of ids; all ids."""

    text: str
    start: np.ndarray
    end: np.ndarray
    count: np.ndarray
    ids: np.ndarray


class TreeBpe:
    """Encoder and decoder for a BPE vocabulary file with word ends, like word_bpe_49k.json."""

    def __init__(self, path: str, table_entries: int = TABLE_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()} | {x["id"]: x["content"] for x in whole["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(a, b): n for n, (a, b) in enumerate(merges)}
        self.symbols = byte_symbols()
        self.table_entries = table_entries
        self._known: dict[str, list[int]] = {}  # word to its ids
        # For leaves: pairs of ids as ordered numbers, their ranks, what each rank makes; the edge stands at both ends of a word, in no pair.
        self.edge, self.never = max(self.tokens) + 1, len(merges)
        pairs = np.array([self.vocab[a] * (self.edge + 1) + self.vocab[b] for a, b in self.rank] + [NONE], dtype=np.int64)
        order = np.argsort(pairs)
        self.pairs, self.pair_rank = pairs[order], np.array([*self.rank.values(), self.never], dtype=np.int32)[order]
        self.made = np.zeros(len(merges), dtype=np.int32)
        self.made[list(self.rank.values())] = [self.vocab[a + b] for a, b in self.rank]
        self.first = np.array([self.vocab[x + end] for end in ("", SUFFIX) for x in self.symbols] + [self.edge], dtype=np.int32)
        self.first_rank = self._ranks(self.first[:, None], self.first)
        # What stands for an id, and a blank.
        self.id_texts = pa.array([f"{i} " for i in range(self.edge)])
        self.id_tokens = pa.array([f"{self.tokens[i]} " if i in self.tokens else "" for i in range(self.edge)])

    # Words.

    def merge(self, symbols: list[str]) -> list[str]:
        """Plain BPE: the lowest-ranked, leftmost pair first."""
        n = len(symbols)
        if n < 2:
            return symbols
        if n <= LEAF:
            return self._merge_leaf(symbols)
        part: list[str | None] = list(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := self.rank.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j] = a + b, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := self.rank.get((part[i], part[k]))) is not None:
                    heapq.heappush(heap, (r, i, part[i], part[k]))
            if (h := before[i]) >= 0 and (r := self.rank.get((part[h], part[i]))) is not None:
                heapq.heappush(heap, (r, h, part[h], part[i]))
        return [x for x in part if x is not None]

    def _merge_leaf(self, symbols: list[str]) -> list[str]:
        """merge() for few symbols, where a list of all ranks is quicker than a heap."""
        part, get = list(symbols), self.rank.get
        ranks = [get(pair, NONE) for pair in zip(part, part[1:])]
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            part[i : i + 2] = [part[i] + part[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((part[i - 1], part[i]), NONE)
            if i < len(ranks):
                ranks[i] = get((part[i], part[i + 1]), NONE)
        return part

    def _split(self, token: str) -> list[str]:
        """The symbols that a token was merged from."""
        if token.endswith(SUFFIX) and len(token) > len(SUFFIX):
            body = token[: -len(SUFFIX)]
            return [*body[:-1], body[-1] + SUFFIX]
        return list(token)

    def concatenate(self, left: list[str], right: list[str]) -> list[str]:
        """The encoding of two encoded texts in one: windows around the join grow until both sides agree."""
        if not left or not right:
            return left or right
        width = 2
        while True:
            head, tail = left[-width:], right[:width]
            window = self.merge([*chain.from_iterable(map(self._split, head)), *chain.from_iterable(map(self._split, tail))])
            if (width >= len(left) or window[0] == head[0]) and (width >= len(right) or window[-1] == tail[-1]):
                return left[: max(0, len(left) - width)] + window + right[width:]
            width *= 2

    def tree(self, symbols: list[str], leaf: int = LEAF) -> list[str]:
        """BPE of long unsplit text: halves, then their concatenation."""
        if len(symbols) <= leaf:
            return self.merge(symbols)
        half = len(symbols) // 2
        return self.concatenate(self.tree(symbols[:half], leaf), self.tree(symbols[half:], leaf))

    def word(self, word: str) -> list[int]:
        """Ids of one word of any length."""
        symbols = [self.symbols[b] for b in word.encode("utf-8")]
        symbols[-1] += SUFFIX
        return [self.vocab[t] for t in self.tree(symbols)]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids."""
        pair = left.astype(np.int64) * (self.edge + 1) + right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.pair_rank[at], self.never)

    def leaves(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """merge() for many short words, given as places in bytes, a pair of each at a time: their numbers as they were done, how many ids each has, all ids."""
        rows, column = np.arange(len(size)), np.arange(int(size.max()))
        inside = column < size[:, None]
        grid = np.full((len(size), len(column) + 2), 512, dtype=np.int16)
        grid[:, 1:-1][inside] = data[(begin[:, None] + column)[inside]]
        grid[rows, size] += 256
        token, rank = self.first[grid], self.first_rank[grid[:, :-1], grid[:, 1:]]
        done = []
        while len(rows):
            at = rank.argmin(axis=1)
            least = rank[np.arange(len(rows)), at]
            if len(over := np.flatnonzero(least == self.never)):
                ids = token[over]
                done.append((rows[over], (ids != self.edge).sum(axis=1), ids[ids != self.edge]))
                more = np.flatnonzero(least != self.never)
                rows, token, rank, at, least = rows[more], token[more], rank[more], at[more], least[more]
            here, column = np.arange(len(rows)), np.arange(token.shape[1] - 1)
            token[here, at] = self.made[least]
            token = np.where(column > at[:, None], token[:, 1:], token[:, :-1])
            rank = np.where(column[:-1] >= at[:, None], rank[:, 1:], rank[:, :-1])
            rank[here, at - 1] = self._ranks(token[here, at - 1], token[here, at])
            rank[here, at] = self._ranks(token[here, at], token[here, at + 1])
        return tuple(map(np.concatenate, zip(*done)))

    def all_words(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words: the words' numbers in some order, how many ids each has, all ids."""
        data, begin = text_buffer(words)
        size = np.diff(begin)
        order = np.argsort(size, kind="stable")
        short = int(np.searchsorted(size[order], LEAF, side="right"))
        done = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32))]
        for k in range(0, short, MANY):
            part = order[k : min(k + MANY, short)]
            number, count, ids = self.leaves(data, begin[part], size[part])
            done.append((part[number], count, ids))
        for n in order[short:]:
            ids = self.word(words[int(n)].as_py())
            done.append((np.array([n]), np.array([len(ids)]), np.array(ids, dtype=np.int32)))
        return tuple(map(np.concatenate, zip(*done)))

    def _know(self, words: list[str]) -> None:
        """Puts words into the table, which starts anew when full."""
        missing = set(words).difference(self._known)
        if missing and len(self._known) + len(missing) > self.table_entries:
            self._known.clear()
            missing = set(words)
        if missing:
            found = list(missing)
            number, count, ids = self.all_words(pa.array(found, pa.string()))
            self._known.update((found[n], x.tolist()) for n, x in zip(number.tolist(), np.split(ids, np.cumsum(count)[:-1])))

    # Texts.

    def normalise(self, text: str) -> str:
        """The tokenizer's normal form; white space may stay as it is, since no word holds any."""
        return self.library.normalizer.normalize_str(text) if _OTHER.search(text) else text.lower()

    def words(self, normal: str) -> list[str]:
        """Words of a normalised text, in order."""
        if _OTHER.search(normal):
            return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return _SIMPLE.findall(normal)

    def places(self, normal: str) -> list[tuple[int, int]]:
        """Places of the words of a normalised text."""
        if _OTHER.search(normal):
            return [span for _, span in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return [m.span() for m in _SIMPLE.finditer(normal)]

    def digest_parts(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, the ids joined by spaces, the decoded text."""
        return self.all_digest_parts([text])[0]

    def all_digest_parts(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """digest_parts() of each text."""
        runs = [SPECIAL.split(t) if t else [""] for t in texts]  # the library cuts special tokens' own strings out first
        found, out = iter(self._run_parts(list(chain.from_iterable(runs)))), []
        for text, own in zip(texts, runs):
            parts = [next(found)]
            for mark in SPECIAL.findall(text) if len(own) > 1 else ():
                parts += [(1, str(self.library.token_to_id(mark)), mark), next(found)]
            some = [x for x in parts if x[0]]
            out.append(parts[0] if len(parts) == 1 else (sum(n for n, _, _ in some), " ".join(i for _, i, _ in some), " ".join(d for _, _, d in some)))
        return out

    def _run_parts(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """digest_parts() of texts without special tokens, those of one kind together."""
        out = [(0, "", "")] * len(texts)
        simple, other = {}, {}
        for k, text in enumerate(texts):
            if text:
                normal = self.normalise(text)
                (other if _OTHER.search(normal) else simple)[k] = normal
        if simple:
            for k, parts in zip(simple, self._parts(*simple_words(list(simple.values())))):
                out[k] = parts
        if other:
            words = [self.words(x) for x in other.values()]
            first = np.concatenate([[0], np.cumsum(list(map(len, words)))])
            for k, parts in zip(other, self._parts(pa.array(chain.from_iterable(words), pa.string()), first)):
                out[k] = parts
        return out

    def _parts(self, words: pa.StringArray, first: np.ndarray) -> Iterator[tuple[int, str, str]]:
        """digest_parts() of texts given as their words and where each text's begin."""
        coded = words.dictionary_encode()
        number, count, ids = self.all_words(coded.dictionary)
        place = np.empty(len(number), dtype=np.int32)
        place[number] = np.arange(len(number))
        which, begin = place[coded.indices.to_numpy()], np.concatenate([[0], np.cumsum(count)])
        total = np.concatenate([[0], np.cumsum(count[which])])[first]
        texts = (joined(joined(x, ids, begin), which, first).to_pylist() for x in (self.id_texts, self.id_tokens))
        return ((n, i[:-1], d[:-1]) for n, i, d in zip(np.diff(total).tolist(), *texts))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; null and empty have none."""
        return [int(x) for x in self.digest_parts(text)[1].split(" ") if x]

    def decode(self, ids) -> str:
        """The vocabulary has no decoder: tokens joined by single spaces; ids without a token are left out."""
        return " ".join(t for i in ids if (t := self.tokens.get(int(i))) is not None)

    # Pieces of long texts.

    def piece(self, text: str) -> Piece:
        """The encoding of a piece of a text."""
        normal = self.normalise(text)
        return self._piece(normal, self.places(normal))

    def _piece(self, normal: str, places: list[tuple[int, int]]) -> Piece:
        words = [normal[a:b] for a, b in places]
        self._know(words)
        found = [self._known[w] for w in words]
        ends = np.array(places, dtype=np.int64).reshape(-1, 2)
        return Piece(normal, ends[:, 0], ends[:, 1], np.array(list(map(len, found)), dtype=np.int64), np.array(list(chain.from_iterable(found)), dtype=np.int32))

    def join(self, left: Piece, right: Piece) -> Piece:
        """The encoding of two neighbouring pieces in one."""
        edge = len(left.text)
        kept = int(np.searchsorted(left.end, edge - MARGIN, side="right"))
        low = int(left.end[kept - 1]) if kept else 0
        text = left.text + right.text
        width = 8
        while True:
            whole = width >= len(right.start)
            high = len(text) if whole else edge + int(right.start[width])
            window = [(a + low, b + low) for a, b in self.places(text[low:high])]
            sure = [a for a, b in window if edge <= a <= high - MARGIN]
            agreed = np.intersect1d(np.array(sure, dtype=np.int64), right.start[:width] + edge) if not whole else np.array([len(text)])
            if len(agreed):
                break
            width *= 2
        stop = int(agreed[0])
        skip = int(np.searchsorted(right.start + edge, stop, side="left")) if not whole else len(right.start)
        middle = self._piece(text, [(a, b) for a, b in window if a < stop])
        return Piece(
            text,
            np.concatenate([left.start[:kept], middle.start, right.start[skip:] + edge]),
            np.concatenate([left.end[:kept], middle.end, right.end[skip:] + edge]),
            np.concatenate([left.count[:kept], middle.count, right.count[skip:]]),
            np.concatenate([left.ids[: int(left.count[:kept].sum())], middle.ids, right.ids[int(right.count[:skip].sum()) :]]),
        )

    def join_all(self, pieces: list[Piece]) -> Piece:
        """A balanced tree of joins."""
        while len(pieces) > 1:
            pieces = [self.join(*pieces[k : k + 2]) if k + 1 < len(pieces) else pieces[k] for k in range(0, len(pieces), 2)]
        return pieces[0]


def cut(text: str, size: int) -> list[str]:
    """Pieces of about size characters, each but the first beginning with an ASCII character.

    Nothing before an ASCII character composes with it, so pieces can be
    normalised alone.
    """
    out, at = [], 0
    while len(text) - at > size:
        to = at + size
        while to < len(text) and not text[to].isascii():
            to += 1
        out.append(text[at:to])
        at = to
    return [*out, text[at:]]


def runs(text: str, size: int) -> list[tuple[int, str]]:
    """Pieces with the number of their run: special tokens' own strings stand alone between runs of text."""
    out, at, run = [], 0, 0
    for m in SPECIAL.finditer(text):
        out += [(run, x) for x in cut(text[at : m.start()], size) if x] + [(run + 1, m[0])]
        at, run = m.end(), run + 2
    return out + [(run, x) for x in cut(text[at:], size) if x]


_ENCODERS: dict[str, TreeBpe] = {}


def encoder(path: str) -> TreeBpe:
    """One encoder a process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TreeBpe(path)
    return _ENCODERS[path]


_ADDED = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>", "decoded": "string"}
_ARROW = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def _row(n: int, ids: str, decoded: str, add) -> dict:
    make = {"n_tokens": lambda: n, "ids_sha256": lambda: _sha(ids), "decoded_sha256": lambda: _sha(decoded), "ids": lambda: np.array(ids.split(), dtype=np.int32), "decoded": lambda: decoded}
    return {k: make[k]() for k in add}


def encode_texts(df: DataFrame, path: str, text: str = "text", add: tuple[str, ...] = tuple(_ADDED), keep_text: bool = True, long_text: int = LONG_TEXT) -> DataFrame:
    """Encodes and decodes every whole text; adds the chosen columns (same names are replaced).

    add chooses among n_tokens, ids, decoded and the SHA-256 digests of ids
    (decimal, joined by one space) and of the decoded text; keep_text=False
    leaves out the text.  Null and empty texts have no ids and an empty decoded
    text.  Rows are kept as they are, repeated ones too; an empty table gives an
    empty one.  path is a tokenizer file that every executor can read there.
    """
    names = [c for c in df.columns if c.lower() not in add and (keep_text or c.lower() != text.lower())]
    wide = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("__bpe_text"))
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names), *(f"`{k}` {_ADDED[k]}" for k in add)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for whole in batches:
            for batch in slices(whole, "__bpe_text", SLICE_BYTES):
                rows = [_row(*parts, add) for parts in bpe.all_digest_parts(batch.column("__bpe_text").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array([r[k] for r in rows], type=_ARROW[_ADDED[k]]) for k in add], [*names, *add])

    is_long = F.coalesce(F.char_length("__bpe_text") > long_text, F.lit(False))
    short = small_batches(wide).filter(~is_long).mapInArrow(encode, schema)
    return short.unionByName(_encode_long(wide.filter(is_long), path, names, add, schema, long_text))


def _encode_long(wide: DataFrame, path: str, names: list[str], add, schema: str, size: int) -> DataFrame:
    """Texts in pieces: dealt out, encoded in parallel, joined a text at a time."""
    keyed = wide.withColumn("__row", F.monotonically_increasing_id())
    place = ["__row", "__run", "__part"]
    rest = ", ".join([*(f"`{c}` {wide.schema[c].dataType.simpleString()}" for c in names), "__row long, __run int, __part int"])

    def to_pieces(batches):
        for whole in batches:
            for batch in slices(whole, "__bpe_text", SLICE_BYTES):
                parts = [runs(t.as_py(), size) for t in batch.column("__bpe_text")]
                index = pa.array(np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
                arrays = [batch.column(c).take(index) for c in [*names, "__row"]]
                made = [pa.array([run for p in parts for run, _ in p], pa.int32()), pa.array([k for p in parts for k in range(len(p))], pa.int32()), pa.array([x for p in parts for _, x in p], pa.string())]
                yield pa.RecordBatch.from_arrays([*arrays, *made], [*names, *place, "piece"])

    def encode(batches):
        bpe = encoder(path)
        for whole in batches:
            for batch in slices(whole, "piece", SLICE_BYTES):
                found = [None if SPECIAL.fullmatch(t.as_py()) else bpe.piece(t.as_py()) for t in batch.column("piece")]
                text = [t.as_py() if p is None else p.text for t, p in zip(batch.column("piece"), found)]
                packed = [None if p is None else np.concatenate([[len(p.start)], p.start, p.end, p.count, p.ids]).astype(np.int32).tobytes() for p in found]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in [*names, *place]] + [pa.array(text, pa.string()), pa.array(packed, pa.binary())], [*names, *place, "piece", "packed"])

    def unpack(text: str, packed: bytes) -> Piece:
        x = np.frombuffer(packed, dtype=np.int32).astype(np.int64)
        n = int(x[0])
        return Piece(text, x[1 : n + 1], x[n + 1 : 2 * n + 1], x[2 * n + 1 : 3 * n + 1], x[3 * n + 1 :].astype(np.int32))

    def combine(group: pa.Table) -> pa.Table:
        bpe = encoder(path)
        group = group.sort_by("__part")
        ids: list[int] = []
        for _, run in groupby(zip(group["__run"].to_pylist(), group["piece"].to_pylist(), group["packed"].to_pylist()), key=lambda x: x[0]):
            pieces = list(run)
            ids += [bpe.library.token_to_id(pieces[0][1])] if pieces[0][2] is None else bpe.join_all([unpack(*x[1:]) for x in pieces]).ids.tolist()
        row = _row(len(ids), " ".join(map(str, ids)), bpe.decode(ids), add)
        return pa.table([group[c].slice(0, 1).combine_chunks() for c in names] + [pa.array([row[k]], type=_ARROW[_ADDED[k]]) for k in add], names=[*names, *add])

    # A number of partitions is named so that few but costly pieces aren't brought together in one task.
    parts = int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = keyed.mapInArrow(to_pieces, f"{rest}, piece string").repartition(parts, "__row", "__part")
    return pieces.mapInArrow(encode, f"{rest}, piece string, packed binary").groupBy("__row").applyInArrow(combine, schema)
