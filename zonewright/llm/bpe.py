r"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

A word's symbols are leaves of a minimum tree whose keys are (rank of the pair that starts here, position): the root is the leftmost
pair of the lowest rank. A merge changes three leaves at most, each in logarithmic time, until the root says that no pair can
merge. Words repeat, so a task keeps a memo of short words it has encoded: at most MEMO of them, of MEMO_CHARS characters at most, given up at its end.

The vocabulary is a tokenizers JSON file (model BPE, pre-tokenizer and decoder ByteLevel); its path is a parameter, read on the driver and
broadcast (its size is the file's). Added tokens inside texts become their ids, as in the library.

Defined results: a null text is an empty one (no tokens). Rows are independent, so ties, repeated rows, empty tables and other columns do not
matter. Texts are encoded whole, one at a time; a word without bounds (a run of a million letters) is merged in n log n steps.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a task remembers at most, the characters of the longest of them, and characters of text encoded together.
MEMO, MEMO_CHARS, TOGETHER = 1 << 18, 48, 1 << 20
_NONE = np.int64(1) << np.int64(62)
#: A space before a space or before the end, behind white space: there a cut could change the words.
_UNSAFE, _CUT = regex.compile(r"\s (?:\s|$)"), regex.compile(r" (?=\S)")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, spec: str):
        data = json.loads(spec)
        model, added = data["model"], data.get("added_tokens", [])
        if model["type"] != "BPE" or data["pre_tokenizer"]["type"] != "ByteLevel" or data.get("normalizer") or model.get("byte_fallback") or model.get("ignore_merges") or data["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only plain byte-level BPE files are supported")
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
            raise ValueError("added tokens must be plain strings")
        letters, vocab = byte_letters(), model["vocab"]
        self.first = [0] * 256
        for letter, b in letters.items():
            self.first[b] = vocab[letter]
        self.pairs: dict[int, tuple[int, int]] = {}  # left << 32 | right: (rank, id)
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.pairs[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        size = 1 + max([*vocab.values(), *(a["id"] for a in added)])
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        self.special = {a["content"]: a["id"] for a in added}
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.tokens = pa.array(self.bytes, pa.large_binary())
        self.decimal = pa.array([f"{i}," for i in range(size)], pa.large_binary())
        self.split = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.special, key=len, reverse=True))) if added else None
        self.words = regex.compile(PATTERN)
        self.known: dict[str, tuple[int, ...]] = {}
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.ranks = np.array([self.pairs[int(k)][0] for k in self.keys], np.int64)
        self.made = np.zeros(len(self.pairs), np.int64)
        for rank, i in self.pairs.values():
            self.made[rank] = i
        self.odd: re.Pattern | None = None

    def word(self, word: str) -> tuple[int, ...]:
        """Merges one word. The tree's keys are rank << 40 | position."""
        ids = [self.first[b] for b in word.encode()]
        n = len(ids)
        if n < 2:
            return tuple(ids)
        pairs, none = self.pairs, 1 << 80
        size = 1
        while size < n - 1:
            size *= 2
        tree = [none] * (2 * size)
        for i in range(n - 1):
            if p := pairs.get(ids[i] << 32 | ids[i + 1]):
                tree[size + i] = p[0] << 40 | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        mask = (1 << 40) - 1

        def put(i: int, key: int) -> None:
            i += size
            tree[i] = key
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                if b < a:
                    a = b
                if tree[i] == a:
                    return
                tree[i] = a
                i >>= 1

        while (root := tree[1]) != none:
            i = root & mask
            j = after[i]
            ids[i], ids[j] = pairs[ids[i] << 32 | ids[j]][1], -1
            k = after[i] = after[j]
            if j < n - 1:
                put(j, none)
            if k < n:
                before[k] = i
                p = pairs.get(ids[i] << 32 | ids[k])
                put(i, p[0] << 40 | i if p else none)
            else:
                put(i, none)
            if (h := before[i]) >= 0:
                p = pairs.get(ids[h] << 32 | ids[i])
                put(h, p[0] << 40 | h if p else none)
        return tuple(x for x in ids if x >= 0)

    def _rank(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, ok: np.ndarray) -> np.ndarray:
        """Tree keys of many pairs at their positions."""
        pair = left.astype(np.int64) << 32 | np.maximum(right, 0).astype(np.int64)
        k = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(ok & (self.keys[k] == pair), self.ranks[k] << 8 | at, _NONE)

    def _merged(self, words: list[bytes], width: int) -> list[tuple[int, ...]]:
        """As word(), for many words of at most `width` bytes (a power of two, at most 256) at a time: a tree for each, in rows of arrays."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        inside = np.arange(width) < n[:, None]
        ids = np.full((len(words), width), -1, np.int64)
        ids[inside] = np.array(self.first, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
        tree = np.full((len(words), 2 * width), _NONE, np.int64)
        at = np.broadcast_to(np.arange(width - 1), (len(words), width - 1))
        tree[:, width : 2 * width - 1] = self._rank(np.maximum(ids[:, :-1], 0), ids[:, 1:], at, inside[:, 1:])
        for i in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
        after = np.broadcast_to(np.arange(1, width + 1), ids.shape).copy()
        before = np.broadcast_to(np.arange(-1, width - 1), ids.shape).copy()
        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while len(rows):
            root = tree[rows, 1]
            i = root & 255
            j = after[rows, i]
            k = after[rows, j]
            new = self.made[root >> 8]
            ids[rows, i], ids[rows, j], after[rows, i] = new, -1, k
            has = k < n[rows]
            kk = np.minimum(k, width - 1)
            before[rows[has], kk[has]] = i[has]
            h = before[rows, i]
            hh = np.maximum(h, 0)
            key_i = self._rank(new, ids[rows, kk], i, has)
            key_h = self._rank(np.maximum(ids[rows, hh], 0), new, hh, h >= 0)
            tree[rows, width + j] = _NONE
            tree[rows, width + i] = key_i
            tree[rows[h >= 0], width + hh[h >= 0]] = key_h[h >= 0]
            for leaf in (j, i, hh):
                node = (width + leaf) >> 1
                for _ in range(width.bit_length() - 1):
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node >>= 1
            rows = rows[tree[rows, 1] != _NONE]
        flat, ends = ids[ids >= 0].tolist(), np.cumsum((ids >= 0).sum(1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]

    def _learn(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """The ids of words; those that the memo lacks are encoded together."""
        known = self.known
        fresh = words.difference(known)
        found = {w: known[w] for w in words - fresh}
        todo = [(w, w.encode()) for w in fresh]
        for low, width in ((0, 8), (8, 16), (16, 32), (32, 64)):
            own = [x for x in todo if low < len(x[1]) <= width]
            for a in range(0, len(own), 4096):
                part = own[a : a + 4096]
                found.update(zip((w for w, _ in part), self._merged([b for _, b in part], width)))
        found.update((w, self.word(w)) for w, b in todo if len(b) > 64)
        for w in fresh:
            if len(w) <= MEMO_CHARS:
                if len(known) >= MEMO:
                    known.clear()
                known[w] = found[w]
        return found

    def pieces(self, text: str) -> list[str]:
        """The words. Letters and digits newer than the library's tables (unassigned in this Python's) count as symbols there."""
        if text.isascii() or ord(max(text)) < 0x558:
            return self.words.findall(text)
        if self.odd is None:
            new = [c for c in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))) if unicodedata.category(c) == "Cn"]
            self.odd = re.compile("[" + "".join(map(re.escape, new)) + "]" if new else r"(?!)")
        if self.odd.search(text):
            return [text[m.start() : m.end()] for m in self.words.finditer(self.odd.sub("\ue000", text))]
        return self.words.findall(text)

    def _chunks(self, texts: list[str]) -> pa.ListArray:
        """The texts cut before spaces where a cut changes no word; all but a text's first chunk have lost their space."""
        odd = [i for i, t in enumerate(texts) if _UNSAFE.search(t)]
        if not odd:
            return pc.split_pattern(pa.array(texts, pa.string()), " ")
        at, other = np.array(odd), np.setdiff1d(np.arange(len(texts)), odd)
        plain = pc.split_pattern(pa.array([texts[i] for i in other], pa.string()), " ")
        both = pa.concat_arrays([plain, pa.array([_CUT.split(texts[i]) for i in odd], pa.list_(pa.string()))])
        return both.take(pa.array(np.argsort(np.concatenate([other, at]))))

    def encode_column(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of all texts, one behind the other. Each different chunk is encoded once, and its ids are gathered where it occurs."""
        owner, strings, special = [], [], {}  # special: part number to an added token's id
        for n, text in enumerate(texts):
            if self.split and any(t in text for t in self.special):
                for x in filter(None, self.split.split(text)):
                    if x in self.special:
                        special[len(owner)] = self.special[x]
                    owner.append(n)
                    strings.append("" if x in self.special else x)
            elif text:
                owner.append(n)
                strings.append(text)
        if not owner:
            return np.zeros(len(texts) + 1, np.int64), np.empty(0, np.int32)
        lists = self._chunks(strings)
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        coded = lists.flatten().dictionary_encode()
        chunks, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        heads = [chunks[i] for i in code[begins]]
        firsts = {h: i for i, h in enumerate(dict.fromkeys(heads))}
        split = []
        for c in chunks:  # mostly letters, or those and a mark
            if c.isalpha():
                split.append((" " + c,))
            elif c[:-1].isalpha() and c[-1] in ".,;:!?":
                split.append((" " + c[:-1], c[-1]))
            else:
                split.append(self.pieces(" " + c))
        split += map(self.pieces, firsts)
        ids = self._learn(set(chain.from_iterable(split)))
        found = [ids[ws[0]] if len(ws) == 1 else tuple(chain.from_iterable(map(ids.__getitem__, ws))) for ws in split]
        found += [(x,) for x in special.values()]
        code[begins] = [len(chunks) + firsts[h] for h in heads]
        code[begins[list(special)]] = np.arange(len(split), len(found))
        each = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(each.sum()))
        count = each[code]
        ends = np.cumsum(count)
        at = np.repeat((np.cumsum(each) - each)[code] - (ends - count), count) + np.arange(len(ends) and ends[-1])
        per_part = np.add.reduceat(count, begins)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.bincount(owner, per_part, len(texts)).astype(np.int64), out=offsets[1:])
        return offsets, flat[at]

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        offsets, ids = self.encode_column(texts)
        return [x.tolist() for x in np.split(ids, offsets[1:-1])] if texts else []

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0]

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def decoded(self, offsets: np.ndarray, ids: np.ndarray):
        """Yields the text of each row of ids."""
        for x in _joined(self.tokens, offsets, ids):
            yield str(x, "utf-8", "replace")


def _joined(values: pa.Array, offsets: np.ndarray, ids: np.ndarray):
    """Yields the bytes of each row's values, one behind the other."""
    taken = values.take(pa.array(ids))
    at = np.frombuffer(taken.buffers()[1], np.int64)[offsets] if len(ids) else np.zeros(len(offsets), np.int64)
    data = memoryview(taken.buffers()[2] or b"")
    for a, e in zip(at[:-1].tolist(), at[1:].tolist()):
        yield data[a:e]


_loaded: dict[str, Bpe] = {}


def loaded(spec: str) -> Bpe:
    """One coder per worker: that of the vocabulary used last."""
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Bpe(spec)
    return _loaded[key]


def _slices(sizes: list[int]):
    """(start, end) of runs of texts with a bounded number of characters."""
    at = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= TOGETHER:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(sizes) or not sizes:
        yield at, len(sizes)


def _mapped(docs: DataFrame, path: str, text: str, keep: tuple[str, ...], fields: list[tuple[str, str]], made) -> DataFrame:
    """Adds fields, whose arrays made(coder, offsets, ids) gives for a run of texts."""
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    cols = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    names = [*keep, *(f[0] for f in fields)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema if f.name != "_text"), *(f"{n} {t}" for n, t in fields)])

    def run(batches):
        coder = loaded(spec.value)
        try:
            for b in batches:
                for start, end in _slices(pc.utf8_length(b.column("_text")).to_pylist()):
                    part = b.slice(start, end - start)
                    gc.disable()  # many tuples are made, and no cycles
                    offsets, ids = coder.encode_column(part.column("_text").to_pylist())
                    gc.enable()
                    yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *made(coder, offsets, ids)], names=names)
        finally:  # the worker goes on to other tasks
            gc.enable()
            coder.known.clear()

    return cols.mapInArrow(run, schema)


def _id_lists(offsets: np.ndarray, ids: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))


def _text_digests(coder: Bpe, offsets: np.ndarray, ids: np.ndarray) -> pa.Array:
    return pa.array([hashlib.sha256(x.encode()).hexdigest() for x in coder.decoded(offsets, ids)], pa.string())


def encoded(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Adds ids, the token ids of each text."""
    return _mapped(docs, path, text, keep, [("ids", "array<int>")], lambda c, offsets, ids: [_id_lists(offsets, ids)])


def decoded(tokens: DataFrame, path: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The texts of token ids; bytes that are not UTF-8 become U+FFFD. Null ids: empty text."""
    with open(path, encoding="utf-8") as f:
        spec = tokens.sparkSession.sparkContext.broadcast(f.read())
    cols = tokens.select(*keep, F.col(ids).alias("_ids"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema if f.name != "_ids"), "text string"])

    def run(batches):
        coder = loaded(spec.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array([coder.decode(x.as_py() or ()) for x in b.column("_ids")], pa.string())], names=[*keep, "text"])

    return cols.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encodes and decodes: n_tokens, and SHA-256 of the comma-joined decimal ids and of the decoded text."""

    def made(coder: Bpe, offsets: np.ndarray, ids: np.ndarray) -> list[pa.Array]:
        joined = [hashlib.sha256(x[:-1]).hexdigest() for x in _joined(coder.decimal, offsets, ids)]
        return [pa.array(np.diff(offsets)), pa.array(joined, pa.string()), _text_digests(coder, offsets, ids)]

    return _mapped(docs, path, text, keep, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], made)


def tokenized(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The token ids of each text, with their number and the digest of what they decode to."""
    fields = [("ids", "array<int>"), ("n_tokens", "long"), ("decoded_sha256", "string")]
    return _mapped(docs, path, text, keep, fields, lambda c, offsets, ids: [_id_lists(offsets, ids), pa.array(np.diff(offsets)), _text_digests(c, offsets, ids)])
