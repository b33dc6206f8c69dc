"""Exact BPE encoding and decoding by speculation: propose greedily, verify in bulk, merge exactly only where that fails.

The vocabulary is a word-end BPE file of the ``tokenizers`` library whose merges are numbered in order, so that a token's
id is also the time at which its merge is made. For all new words of a batch at once, numpy proposes tokens by greedy
longest match in a byte trie, then tests every adjacent pair: a sequence of tokens is the encoding exactly when each
neighbouring pair would stay apart if its two tokens were encoded alone. Words with a pair that fails are merged step by
step, again for all such words at once.

White space never joins a token, so a text is the concatenation of its white-space separated chunks; each worker keeps a
bounded cache of chunks. Words of all scripts and lengths are encoded here. For chunks with characters outside plain
Latin text the vocabulary's own normaliser and splitter say what the words are, as their Unicode tables decide that;
special tokens are found by their spelling before.

Defined cases: null texts encode as empty (no tokens, empty decoded text). Repeated rows are each encoded.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm import shared

VOCABULARY = "word_bpe_49k.json"
#: Tokens of more bytes aren't proposed; the few words that have one fail the test of pairs and are merged exactly.
PROPOSED = 48
#: Words are handled in matrices of at most so many cells; words of more than LONG bytes one at a time.
CELLS, LONG = 1_000_000, 256
#: Places of a long word at which tokens are looked for at once.
PLACES = 1 << 18
#: Chunks, and their characters, that a worker remembers before it begins anew; pairs of tokens that it remembers.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 8_000_000
KNOWN_PAIRS = 300_000
#: Characters for which Python's lower() and regex classes agree with the library's, and which are in normal form C.
PLAIN = re.compile("[\x21-\x7e\xa1-\xac\xae-\xffĀ-įı-ňŊ-ž–—‘’“”…€]+")
PLAIN_TEXT = re.compile(f"[ \t\n\r{PLAIN.pattern[1:-2]}]*")
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: str.split() takes these for white space, the vocabulary's pattern doesn't.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
SPACE = regex.compile(r"\s+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class PairTable:
    """Vectorised map from pairs to numbers, by open addressing: from (left, right) to the merged token, from (node, byte)
    to the node below. -1 where there is none."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = int(np.ceil(np.log2(max(4, len(left) * 5))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        keys = left.astype(np.int64) << 20 | right
        slots, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            empty = self.keys[slots[todo]] < 0
            self.keys[slots[todo[empty]]] = keys[todo[empty]]  # of several in one slot the last stays
            placed = self.keys[slots[todo]] == keys[todo]
            self.values[slots[todo[placed]]] = merged[todo[placed]]
            todo = todo[~placed]
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 20 | right.astype(np.int64)
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], -1)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slots[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slots[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out


class WordBpe:
    """Encodes and decodes whole texts. One per worker process; see ``load``."""

    def __init__(self, path: str, *, cache_entries: int = CACHE_ENTRIES, speculate: bool = True):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.words = [""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.words[i] = token
        for token in spec["added_tokens"]:
            self.words[token["id"]] = token["content"]
        self.specials = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in spec["added_tokens"]}
        self.special = re.compile(f"({'|'.join(map(re.escape, sorted(self.specials, key=len, reverse=True)))})")
        left = np.array([vocab[a] for a, _ in pairs], np.int32)
        right = np.array([vocab[b] for _, b in pairs], np.int32)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        if not (np.diff(merged) > 0).all() or merged[0] < 2 * 256:
            raise ValueError("the vocabulary's merges aren't numbered in order")
        self.base = int(merged[0])
        self.table = PairTable(left, right, merged)
        self.merges = dict(zip(zip(left.tolist(), right.tolist(), strict=True), merged.tolist(), strict=True))
        self.left = np.arange(len(self.words), dtype=np.int32)
        self.right = self.left.copy()
        self.left[merged], self.right[merged] = left, right
        self.of_char = of_char = {c: b for b, c in enumerate(byte_characters())}
        self.plain_id = np.array([vocab[c] for c in byte_characters()], np.int32)
        self.final_id = np.array([vocab[c + suffix] for c in byte_characters()], np.int32)
        spelled = [(bytes(of_char[c] for c in t.removesuffix(suffix)), t.endswith(suffix), i) for t, i in vocab.items()]
        self._grow_trie(spelled)
        self.known_keys, self.known_ok = np.array([-1], np.int64), np.array([False])
        self.cache: dict[str, bytes] = {}
        self.decoded: dict[str, bytes] = {}
        self.cache_entries, self.speculate, self.held = cache_entries, speculate, 0
        self.counts = {"words": 0, "failed": 0}

    def _grow_trie(self, spelled: list[tuple[bytes, bool, int]]) -> None:
        """Only tokens that the merges themselves arrive at take part: others could never be an encoding's."""
        short = [x for x in spelled if 0 < len(x[0]) <= PROPOSED]
        children: dict[tuple[int, int], int] = {}
        plain, final = [-1], [-1]
        finals = [x for x in short if x[1]]
        others = [x for x in short if not x[1]]
        alone = [self._merge(*self._symbols([x[0] for x in group], last)) for group, last in ((finals, True), (others, False))]
        for group, (tokens, counts), ids in ((finals, alone[0], final), (others, alone[1], plain)):
            for (data, _, i), first, n in zip(group, tokens[:, 0].tolist(), counts.tolist(), strict=True):
                if n != 1 or first != i:
                    continue
                node = 0
                for b in data:
                    nxt = children.get((node, b))
                    if nxt is None:
                        nxt = children[node, b] = len(plain)
                        plain.append(-1)
                        final.append(-1)
                    node = nxt
                ids[node] = i
        at = np.array([*children], np.int64).reshape(-1, 2)
        self.child = PairTable(at[:, 0], at[:, 1], np.fromiter(children.values(), np.int32, len(children)))
        self.node_plain, self.node_final = np.array(plain, np.int32), np.array(final, np.int32)

    def _symbols(self, words: list[bytes], last: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Padded matrix of starting symbols, and lengths."""
        lengths = np.fromiter(map(len, words), np.int32, len(words))
        wide = int(lengths.max())
        at = np.arange(wide) < lengths[:, None]
        data = np.zeros((len(words), wide), np.uint8)
        data[at] = np.frombuffer(b"".join(words), np.uint8)
        out = np.where(at, self.plain_id[data], -1)
        if last:
            rows = np.arange(len(words))
            out[rows, lengths - 1] = self.final_id[data[rows, lengths - 1]]
        return out, lengths.copy()

    def _merge(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of every row: again and again the earliest merge, at its first place."""
        none, wide = np.int32(1 << 30), symbols.shape[1]
        ranks = np.full(symbols.shape, none, np.int32)
        inside = np.arange(wide - 1) < counts[:, None] - 1
        found = self.table.get(symbols[:, :-1][inside], symbols[:, 1:][inside])
        ranks[:, :-1][inside] = np.where(found < 0, none, found)
        live = np.arange(len(symbols))
        while len(live):
            r = ranks[live]
            at = r.argmin(axis=1)
            best = r[np.arange(len(live)), at]
            go = best < none
            live, at, best = live[go], at[go], best[go]
            if not len(live):
                break
            s, r = symbols[live], r[go]
            rows, column = np.arange(len(live)), np.arange(wide)
            take = np.minimum(column + (column > at[:, None]), wide - 1)
            s, r = np.take_along_axis(s, take, 1), np.take_along_axis(r, take, 1)
            s[:, -1], r[:, -1] = -1, none
            s[rows, at] = best
            counts[live] -= 1
            n = counts[live]
            after = np.flatnonzero(at < n - 1)
            found = self.table.get(s[after, at[after]], s[after, at[after] + 1])
            r[rows, at] = none
            r[after, at[after]] = np.where(found < 0, none, found)
            before = np.flatnonzero(at > 0)
            found = self.table.get(s[before, at[before] - 1], s[before, at[before]])
            r[before, at[before] - 1] = np.where(found < 0, none, found)
            symbols[live], ranks[live] = s, r
        return symbols, counts

    def _merge_alone(self, symbols: list[int]) -> list[int]:
        """Exact merging of one long word, by a heap of the pairs that can merge."""
        n, left, right = len(symbols), self.left.tolist(), self.right.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i) for i in range(n - 1) if (m := self.merges.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i]
            if j == n or symbols[i] != left[m] or symbols[j] != right[m]:
                continue  # one of the two has merged otherwise
            symbols[i], symbols[j], after[i] = m, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (m := self.merges.get((symbols[a], symbols[b]))) is not None:
                    heapq.heappush(heap, (m, a))
        return [x for x in symbols if x >= 0]

    def _longest(self, data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest token that starts at each of the places ``at`` of a word that ends at ``ends``, and its bytes."""
        best, size = np.full(len(at), -1, np.int32), np.zeros(len(at), np.int64)
        who, node, depth = np.arange(len(at)), np.zeros(len(at), np.int64), 0
        while len(who):
            p = at[who] + depth
            node = self.child.get(node, data[p])
            depth += 1
            ended = p + 1 == ends[who]
            token = np.where(ended, self.node_final[node], self.node_plain[node])
            ok = (node >= 0) & (token >= 0)
            best[who[ok]], size[who[ok]] = token[ok], depth
            on = (node >= 0) & ~ended
            who, node = who[on], node[on]
        return best, size

    def _propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match, a token of every word at a time."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        ends = starts + lengths
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        tokens = np.full((len(words), int(lengths.max())), -1, np.int32)
        counts = np.zeros(len(words), np.int32)
        live, at = np.arange(len(words)), starts.copy()
        while len(live):
            best, size = self._longest(data, at, ends[live])
            tokens[live, counts[live]] = best
            counts[live] += 1
            at += size
            on = at < ends[live]
            live, at = live[on], at[on]
        return tokens, counts

    def _propose_alone(self, word: bytes) -> np.ndarray:
        """Greedy longest match in one long word: the longest token at every place, then those that follow each other."""
        data = np.frombuffer(word, np.uint8).astype(np.int64)
        tokens, at = [], 0
        for first in range(0, len(data), PLACES):
            places = np.arange(first, min(first + PLACES, len(data)))
            best, size = self._longest(data, places, np.full(len(places), len(data)))
            best, size = best.tolist(), size.tolist()
            while at < first + len(places):
                tokens.append(best[at - first])
                at += size[at - first]
        return np.array(tokens, np.int32)

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b stay apart when encoded next to each other.

        Goes back in time: undo the later of the two tokens' merges; what then lies at the border would have merged
        across it, if that merge comes before the one undone (at equal times the left one is made first).
        """
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), 1 << 30, np.int32)
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            across = self.table.get(x, y)
            bad = (across >= 0) & (across < limit[live])
            ok[live[bad]] = False
            on = ~bad & ((x >= self.base) | (y >= self.base))
            live, x, y = live[on], x[on], y[on]
            of_a = x > y
            limit[live] = np.where(of_a, x, y + 1)
            a[live] = np.where(of_a, self.right[x], x)
            b[live] = np.where(of_a, y, self.left[y])
        return ok

    def _verify(self, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Whether each row's neighbouring tokens all stay apart. Results are remembered by pair."""
        inside = np.arange(1, tokens.shape[1]) < counts[:, None]
        row = np.nonzero(inside)[0]
        keys = tokens[:, :-1][inside].astype(np.int64) << 20 | tokens[:, 1:][inside]
        distinct, back = np.unique(keys, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known_keys, distinct), len(self.known_keys) - 1)
        ok, new = self.known_ok[at], self.known_keys[at] != distinct
        if new.any():
            fresh = distinct[new]
            ok[new] = self._apart((fresh >> 20).astype(np.int32), (fresh & 0xFFFFF).astype(np.int32))
            keep = len(self.known_keys) < KNOWN_PAIRS
            merged = np.concatenate([self.known_keys, fresh]) if keep else fresh
            order = np.argsort(merged, kind="stable")
            self.known_ok = (np.concatenate([self.known_ok, ok[new]]) if keep else ok[new])[order]
            self.known_keys = merged[order]
        good = np.ones(len(tokens), bool)
        good[row[~ok[back]]] = False
        return good

    def _encode_alike(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32 bits) of words of similar lengths, in UTF-8."""
        if self.speculate:
            tokens, counts = self._propose(words)
            failed = np.flatnonzero(~self._verify(tokens, counts))
        else:
            tokens, counts = self._symbols(words)
            failed = np.arange(len(words))
        if len(failed):
            self.counts["failed"] += len(failed)
            t, c = self._merge(*self._symbols([words[i] for i in failed]))
            tokens[failed, : t.shape[1]], counts[failed] = t, c
        flat = tokens[np.arange(tokens.shape[1]) < counts[:, None]].astype("<u4").tobytes()
        ends = (np.cumsum(counts) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _encode_alone(self, word: bytes) -> bytes:
        """Ids of one long word."""
        tokens = self._propose_alone(word) if self.speculate else None
        if tokens is None or not self._verify(tokens[None, :], np.array([len(tokens)])).all():
            self.counts["failed"] += 1
            tokens = np.array(self._merge_alone(self._symbols([word])[0][0].tolist()))
        return tokens.astype("<u4").tobytes()

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids (little-endian unsigned 32 bits) of each word; words of like length are encoded together."""
        spelled = sorted(((w, w.encode()) for w in words), key=lambda x: len(x[1]))
        self.counts["words"] += len(spelled)
        out, at = {}, 0
        while at < len(spelled) and len(spelled[at][1]) <= LONG:
            part = spelled[at : at + CELLS // PROPOSED]
            while len(part) > 1 and (len(part) * len(part[-1][1]) > CELLS or len(part[-1][1]) > LONG):
                part = part[: len(part) // 2]
            out.update(zip((w for w, _ in part), self._encode_alike([data for _, data in part]), strict=True))
            at += len(part)
        for word, data in spelled[at:]:
            out[word] = self._encode_alone(data)
        return out

    def _words(self, chunk: str) -> list[str]:
        """A chunk's words and special tokens, by the vocabulary's rules."""
        out: list[str] = []
        for k, run in enumerate(self.special.split(chunk)):
            if k % 2:
                out.append(run)
            elif run:
                found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(run))
                out.extend(bytes(map(self.of_char.__getitem__, word)).decode() for word, _ in found)
        return out

    def learn(self, chunks: set[str]) -> None:
        """Put the ids of new chunks into the cache."""
        joined = "".join(chunks)
        plain = PLAIN.fullmatch(joined) is not None and self.special.search(joined) is None
        whole: list[str] = []
        parts: dict[str, list[str]] = {}
        other: dict[str, list[str]] = {}
        for chunk in chunks:
            if not plain and (PLAIN.fullmatch(chunk) is None or self.special.search(chunk) is not None):
                other[chunk] = self._words(chunk)
                continue
            low = chunk.lower()
            if low.isalpha():
                if low == chunk:
                    whole.append(chunk)
                else:
                    parts[chunk] = [low]
            elif low[-1] in ",." and low[:-1].isalpha():
                parts[chunk] = [low[:-1], low[-1]]
            else:
                parts[chunk] = PIECES.findall(low)
        wanted = {p for found in parts.values() for p in found}.difference(self.cache)
        wanted.update(whole)
        wanted.update(p for found in other.values() for p in found)
        known = self.encode_words(wanted.difference(self.specials)) | self.specials
        for chunk, found in (*parts.items(), *other.items()):
            ids = [known[p] if p in known else self.cache[p] for p in found]
            self.cache[chunk] = ids[0] if len(ids) == 1 else b"".join(ids)
        for chunk in whole:
            self.cache[chunk] = known[chunk]

    def _split(self, text: str) -> list[str]:
        """White-space separated chunks; in lower case where the whole text is plain."""
        if PLAIN_TEXT.fullmatch(text) is not None and self.special.search(low := text.lower()) is None:
            return low.split()
        if any(s in text for s in SEPARATORS):
            return [x for x in SPACE.split(text) if x]
        return text.split()

    def _chunks(self, texts: list[str]) -> list[list[str]]:
        """Each text's chunks, all of them in the cache."""
        split = [self._split(t) for t in texts]
        new = set().union(*split).difference(self.cache) if split else set()
        if new:
            if len(self.cache) + len(new) > self.cache_entries or self.held > CACHE_CHARS:
                self.cache, self.decoded, self.held = {}, {}, 0
                new = set().union(*split)
            self.held += sum(map(len, new))
            self.learn(new)
        return split

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        split = self._chunks(texts)
        get = self.cache.__getitem__
        for chunks in split:
            yield b"".join(map(get, chunks))

    def decode(self, ids: bytes) -> str:
        """What the library's decode(ids, skip_special_tokens=False) gives: the tokens, joined by spaces."""
        return " ".join([self.words[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def round_trip(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Ids and decoded UTF-8 of each text."""
        split = self._chunks(texts)
        get, decoded = self.cache.__getitem__, self.decoded
        for chunks in split:
            for chunk in set(chunks).difference(decoded):
                decoded[chunk] = self.decode(get(chunk)).encode()
            spelled = b" ".join(map(decoded.__getitem__, chunks))
            yield b"".join(map(get, chunks)), spelled


_LOADED: dict[str, WordBpe] = {}


def unload() -> None:
    """Forget this process's encoders: workers live on, and the next task may need the room for something else."""
    _LOADED.clear()


def load(path: str) -> WordBpe:
    """This process's encoder for a vocabulary file."""
    if path not in _LOADED:
        shared.give_back()  # what an earlier stage freed in this worker, before the encoder comes on top
        _LOADED[path] = WordBpe(path)
        shared.give_back()  # the vocabulary as it was read
    return _LOADED[path]


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded text of every row of ``docs`` (doc_id, text)."""
    path = path or vocabulary_path()
    shared.prepare(docs.sparkSession)

    def run(batches):
        bpe = load(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            both = list(bpe.round_trip(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(i) // 4 for i, _ in both], pa.int64()), pa.array([i for i, _ in both], pa.binary()), pa.array([d.decode() for _, d in both], pa.string())],
                names=["doc_id", "n_tokens", "ids", "decoded"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """As ``encode_decode``, with SHA-256 digests in place of ids and text; they are made where the ids are."""
    path = path or vocabulary_path()
    shared.prepare(docs.sparkSession)

    def run(batches):
        bpe = load(path)
        for batch in batches:
            n, ids, decoded = [], [], []
            for i, d in bpe.round_trip(batch.column(1).to_pylist()):
                n.append(len(i) // 4)
                ids.append(hashlib.sha256(i).hexdigest())
                decoded.append(hashlib.sha256(d).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(shared.table(spark, sf_dir, "documents"))


QUERIES = {"op9_bpe": op9_bpe}
ORACLE_SQL: dict[str, str] = {}
