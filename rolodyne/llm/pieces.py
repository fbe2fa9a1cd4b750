"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut where a space begins a word (no piece of such a vocabulary holds
a space after another character, which is checked), the distinct words of a
batch are laid out as flat symbol arrays, and in each round every word merges
its best-ranked pair wherever it stands, leftmost first; finished words leave
the arrays. As rounds grow with the length of a word, words are cut beforehand
wherever no piece holds the two characters that meet there: no merge can cross
such a place, so that text without spaces falls into short words, too. What is
not finished after ROUNDS rounds, such as a short pattern repeated a hundred
thousand times, is merged pair by pair from a heap. Ids equal those of the sentencepiece library for models with
identity normalisation, a dummy prefix, no whitespace removal and byte
fallback; other models are refused when loaded.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, slices

SPACE, NONE = "▁", np.int32(2**31 - 1)
#: Encoded words, and ids of them, that a worker remembers between batches.
REMEMBERED, REMEMBERED_IDS = 300_000, 4_000_000
ROUNDS = 400


class _Table:
    """Open addressing from pairs of symbols to the rank of their merge."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = 20):
        while len(keys) * 4 > 1 << bits:
            bits += 1
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        at, self.probes = self._slot(keys), 0
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] == -1
            _, first = np.unique(np.where(free, at[left], -1 - left), return_index=True)
            put = left[first][free[first]]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & self.mask
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found != -1)]
        return out


def _split_run(size: int, allowed: set[int]) -> list[int]:
    """How a run of single spaces ends up when equal scores merge from the left."""
    run, at = [1] * size, 0
    while at + 1 < len(run):
        if run[at] + run[at + 1] in allowed:
            run[at : at + 2] = [run[at] + run[at + 1]]
            at = 0
        else:
            at += 1
    return run


class PieceCodec:
    """Symbols are ranks: vocabulary pieces in order of their merge priority;
    characters outside the vocabulary are numbered from `n` on by code point."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n = n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.byte_id = np.zeros(256, np.int32)
        for i in special:
            if sp.is_byte(i):
                self.byte_id[int(pieces[i][1:-1], 16)] = i
        normal = {p: i for i, p in enumerate(pieces) if i not in special}
        for text, want in (("Ａ  b ", "Ａ  b "), (" a\n", " a\n"), ("ﬁ", "ﬁ")):
            if sp.decode(sp.encode(text)) != want or not any(map(sp.is_byte, range(n))):
                raise ValueError("only identity normalisation with byte fallback is supported")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in normal):
            raise ValueError("a piece holds a space after another character")
        score = {p: sp.get_score(i) for p, i in normal.items()}
        # runs of spaces share the lowest score; they are merged last, greedily from the left
        runs = {p for p in normal if len(p) > 1 and not p.strip(SPACE)}
        self.longest_run = max(map(len, runs), default=1)
        low = min(score.values())
        self.splits = [_split_run(k, {len(p) for p in runs}) for k in range(3 * self.longest_run)]
        if any(self.splits[k] != [self.longest_run] * (k // self.longest_run) + self.splits[k % self.longest_run] for k in range(len(self.splits))) or any(score[p] != low for p in runs) or any(SPACE * 2 in p for p in normal if p not in runs):
            raise ValueError("pieces of several spaces are not laid out as expected")
        order = sorted((p for p in normal if p not in runs), key=lambda p: -score[p])
        if len({score[p] for p in order if len(p) > 1}) != sum(len(p) > 1 for p in order):
            raise ValueError("scores of merged pieces are not distinct")
        rank = {p: r for r, p in enumerate(order)}
        self.id_of = np.array([normal[p] for p in order], np.int32)
        self.run_id = np.array([normal.get(SPACE * k, 0) for k in range(self.longest_run + 1)], np.int32)
        self.space = rank[SPACE]
        keys, values, last = [], [], {}
        self.simple = np.ones(len(order), bool)  # no longer piece around it has a better rank
        for p, r in rank.items():
            for cut in range(1, len(p)):
                left, right = rank.get(p[:cut]), rank.get(p[cut:])
                if left is not None and right is not None:
                    keys.append((left << 22) | right)
                    values.append(r)
                    for part in (left, right):
                        last[part] = min(last.get(part, r), r)
        for part, r in last.items():
            self.simple[part] = r > part
        self.pairs = _Table(np.array(keys, np.int64), np.array(values, np.int32))
        chars = {ord(p): r for p, r in rank.items() if len(p) == 1}
        meet = {(rank[a] << 22) | rank[b] for p in rank for a, b in zip(p, p[1:]) if a in rank and b in rank}
        self.meeting = _Table(np.array(sorted(meet), np.int64), np.zeros(len(meet), np.int32))
        self.char = np.arange(0x110000, dtype=np.int32) + np.int32(n)
        self.char[list(chars)] = list(chars.values())
        raw = [bytes([int(pieces[i][1:-1], 16)]) if sp.is_byte(i) else b"" if i in special else pieces[i].replace(SPACE, " ").encode() for i in range(n)]
        raw[0] = sp.decode([0]).encode() if 0 in special else raw[0]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_len = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.spaced = np.array([p.startswith(SPACE) for p in pieces])
        self.memory: dict[str, int] = {}
        self._ids, self._lens = [], []

    # encoding -----------------------------------------------------------

    def words(self, text: str) -> list[str]:
        """Words without the space that begins each."""
        if not text:
            return []
        words = text.split(" ")
        if "" in words or SPACE in text:
            return [w[1:] for w in re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", SPACE + text.replace(" ", SPACE))]
        return words

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words (each preceded by a space) -> ids of all, number of ids of each."""
        lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
        points = np.frombuffer((SPACE + SPACE.join(words)).encode("utf-32-le"), np.uint32)
        sym, real = self.char[points], np.repeat(np.arange(len(words)), lens)
        # what is merged by itself: the stretches between places that no piece crosses
        apart = np.ones(len(sym), bool)
        apart[1:] = (real[1:] != real[:-1]) | (self.meeting.get((sym[:-1].astype(np.int64) << 22) | sym[1:]) == NONE)
        word, real = np.cumsum(apart) - 1, real[apart]
        rank = self._rank(sym, word, np.arange(len(sym)))
        done_sym, done_word, rounds = [], [], 0
        while len(sym):
            rounds += 1
            if rounds > ROUNDS:
                starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1], [True])))
                rest = [self._finish(sym[s:e].tolist()) for s, e in zip(starts, starts[1:])]
                done_word.append(np.repeat(word[starts[:-1]], list(map(len, rest))))
                sym = np.array(list(chain.from_iterable(rest)), np.int32)
                done_sym.append(sym)
                break
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            sizes = np.diff(np.append(starts, len(word)))
            best = np.minimum.reduceat(rank, starts)
            live = best != NONE
            if not live.all():
                keep = np.repeat(live, sizes)
                done_sym.append(sym[~keep])
                done_word.append(word[~keep])
                sym, word, rank = sym[keep], word[keep], rank[keep]
                best, sizes = best[live], sizes[live]
                if not len(sym):
                    break
            hit = rank == np.repeat(best, sizes)
            at = np.flatnonzero(hit)
            # of overlapping hits (the same symbol repeated) every second one, from the left
            run = np.concatenate(([True], np.diff(at) > 1))
            first = np.maximum.accumulate(np.where(run, at, 0))
            at = at[(at - first) % 2 == 0]
            # where a longer piece could come first, one merge at a time
            careful = ~self.simple[rank[at]]
            if careful.any():
                later = np.concatenate(([False], word[at][1:] == word[at][:-1]))
                at = at[~(careful & later)]
            sym[at] = rank[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            sym, word, rank = sym[keep], word[keep], rank[keep]
            here = moved[at]
            before = here[here > 0] - 1
            touched = np.concatenate((here, before))
            rank[touched] = self._rank(sym, word, touched)
        sym, word = (np.concatenate(done_sym), np.concatenate(done_word)) if done_sym else (sym, word)
        order = np.argsort(word, kind="stable")
        return self._emit(sym[order], real[word[order]], len(words))

    @cached_property
    def _pair_rank(self) -> dict[int, int]:
        full = self.pairs.keys != -1
        return dict(zip(self.pairs.keys[full].tolist(), self.pairs.values[full].tolist()))

    def _finish(self, sym: list[int]) -> list[int]:
        """Merge one word's symbols pair by pair, the best rank first, then from the left."""
        rank, n = self._pair_rank, len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[key], k) for k in range(n - 1) if (key := (sym[k] << 22) | sym[k + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            best, k = heapq.heappop(heap)
            if sym[k] < 0 or (m := after[k]) >= n or rank.get((sym[k] << 22) | sym[m]) != best:
                continue  # what stood here has been merged since
            sym[k], sym[m], after[k] = best, -1, after[m]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < n and (new := rank.get((sym[left] << 22) | sym[after[left]])) is not None:
                    heapq.heappush(heap, (new, left))
        return [x for x in sym if x >= 0]

    def _rank(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.full(len(at), NONE, np.int32)
        inner = np.flatnonzero(at + 1 < len(sym))
        inner = inner[word[at[inner]] == word[at[inner] + 1]]
        left, right = sym[at[inner]].astype(np.int64), sym[at[inner] + 1].astype(np.int64)
        out[inner] = self.pairs.get((left << 22) | right)
        return out

    def _emit(self, sym: np.ndarray, word: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        # runs of single spaces
        space = sym == self.space
        pair = np.flatnonzero(space[1:] & space[:-1] & (word[1:] == word[:-1]))
        run_size = np.ones(len(sym), np.int64)
        if len(pair):
            starts = pair[np.concatenate(([True], np.diff(pair) > 1))]
            ends = pair[np.concatenate((np.diff(pair) > 1, [True]))] + 1
            keep = np.ones(len(sym), bool)
            for s, e in zip(starts.tolist(), ends.tolist()):
                whole, rest = divmod(e + 1 - s, self.longest_run)
                sizes = np.array([self.longest_run] * whole + self.splits[rest])
                heads = s + np.cumsum(sizes) - sizes
                keep[s : e + 1] = False
                keep[heads] = True
                run_size[heads] = sizes
            sym, word, run_size = sym[keep], word[keep], run_size[keep]
        known = sym < self.n
        if known.all():
            ids = self.id_of[sym]
            lens = np.bincount(word, minlength=count)
        else:
            code = np.where(known, 0, sym - self.n).astype(np.int64)
            width = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
            width[known] = 1
            ids = np.repeat(self.id_of[np.where(known, sym, 0)], width)
            text = code[~known].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            ids[np.repeat(~known, width)] = self.byte_id[np.frombuffer(text, np.uint8)]
            lens = np.bincount(word, weights=width, minlength=count).astype(np.int64)
            run_size = np.repeat(run_size, width)
        several = run_size > 1
        ids[several] = self.run_id[run_size[several]]
        return ids, lens

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """-> ids of all texts, offsets of each (one more than texts)."""
        memory = self.memory
        split = [self.words(t or "") for t in texts]
        flat_words = list(chain.from_iterable(split))
        fresh = [w for w in dict.fromkeys(flat_words) if w not in memory]
        if len(memory) + len(fresh) > REMEMBERED or sum(map(len, self._ids)) > REMEMBERED_IDS:
            memory.clear()
            self._ids, self._lens = [], []
            fresh = list(dict.fromkeys(flat_words))
        if fresh:
            ids, lens = self.merge(fresh)
            memory.update(zip(fresh, range(len(memory), len(memory) + len(fresh))))
            self._ids = [np.concatenate((*self._ids, ids))]
            self._lens = [np.concatenate((*self._lens, lens))]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        total = len(flat_words)
        if not total:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        which = np.fromiter(map(memory.__getitem__, flat_words), np.int64, total)
        ids, lens = self._ids[0], self._lens[0]
        flat, size = _gather(ids, np.cumsum(lens) - lens, lens, which)
        upto = np.concatenate(([0], np.cumsum(size)))
        return flat, upto[np.concatenate(([0], np.cumsum(counts)))]

    # decoding -----------------------------------------------------------

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of flat ids; the space before the first word is dropped and
        bytes that form no character give U+FFFD."""
        flat, size = _gather(self.raw, self.raw_at, self.raw_len, ids)
        upto = np.concatenate(([0], np.cumsum(size)))[offsets]
        data = flat.tobytes()
        out = []
        for k in range(len(offsets) - 1):
            s, e = int(upto[k]), int(upto[k + 1])
            if offsets[k] < offsets[k + 1] and self.spaced[ids[offsets[k]]]:
                s += 1
            out.append(data[s:e].decode("utf-8", "replace"))
        return out


def _gather(values: np.ndarray, at: np.ndarray, lens: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the pieces values[at[i] : at[i] + lens[i]] for i in which."""
    size = lens[which]
    ends = np.cumsum(size)
    shift = at[which] - (ends - size)
    return values[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(shift, size)], size


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """-> (id_col, ids array<int>, decoded string), one row per input row.

    Null texts count as empty: no ids, an empty decoded text. Repeated rows and
    ids are kept, and texts of any length, with or without spaces, are encoded
    whole. `model` names a file of the tokenizer package, which every
    worker has; words a worker has encoded are remembered up to REMEMBERED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path(model))
        for b in slices(batches, "t", 2 << 20):
            ids, at = c.encode(b.column("t").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("i"), lists, pa.array(c.decode(ids, at), pa.string())], ["i", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "i long, ids array<int>, decoded string").withColumnRenamed("i", id_col)


def op3_sentencepiece(spark, sf_dir):
    out = encode_decode(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
