"""BPE encoding by backtracking over longest matches, and decoding through an offset table.

Byte pair encoding is defined by merges in order of rank, but its result can be told
without replaying them: a sequence of tokens is the encoding of the text it spells exactly
if every two neighbours are compatible, that is, if encoding the two of them together gives
the same two back. So a word is read from the left: an Aho-Corasick automaton over all
tokens gives the longest one, each choice is checked against its left neighbour, and where
none fits the last choice is taken back for the next shorter token. The encoding of every
prefix is unique, so a place once found dead is never tried again, and the work is linear
in the word's length however it is spelt.

Whether two tokens are compatible follows from the merges that made them. Going back in
time from the finished pair, the younger of the two symbols at the boundary is split again
and again; if any pair of symbols that stood there together has a merge that came before
either of them was used up, it would have fired across the boundary. Answers are kept in a
table by pair.

A whole batch of new words is matched in one pass of the automaton, and only words in which
two neighbours do not fit are walked singly. The last letter of a word is a letter of its
own (vocabularies with word ends have both), so tokens cannot reach across words. Words
that white space separates are remembered in the worker.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Added to the code of a word's last letter; byte-level letters lie below it.
_LAST = 0x400
_LONGEST_KEPT = 64
_NEVER = 1 << 40
#: Texts are cut at white space after so many characters, so that the words of one are never all in memory.
_CUT = 1 << 20
_WORD = re.compile(r"(?:\S|[\x1c-\x1f])+")  # four control characters that Python takes for white space and the vocabulary does not
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")
_PLAIN = re.compile(r"[!-~]+")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+|\n")


class Merges:
    """The tokens of a vocabulary file, the automaton over them, and which of them may stand side by side."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        suffix, ids = told["model"]["end_of_word_suffix"], told["model"]["vocab"]
        if not suffix:
            raise ValueError("a vocabulary with word ends is needed")
        n = 1 + max([*ids.values(), *(t["id"] for t in told["added_tokens"])])
        self.texts = [""] * n
        for text, at in ids.items():
            self.texts[at] = text
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        for text, at in self.special.items():
            self.texts[at] = text
        self.born, self.left, self.right, self.rank = [-1] * n, [-1] * n, [-1] * n, {}
        for r, pair in enumerate(told["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = ids[a + b]
            if self.born[made] >= 0:
                raise ValueError("every token must have one merge")
            a, b = ids[a], ids[b]
            self.rank[a << 32 | b] = self.born[made] = r
            self.left[made], self.right[made] = a, b
        self.automaton = ahocorasick.Automaton()
        self.size, self.last, self.shorter = [0] * n, np.zeros(n, bool), [-1] * n
        spelt = {}
        for text, at in ids.items():
            ends = text.endswith(suffix) and text != suffix
            spelt[as_last(text[: -len(suffix)]) if ends else text] = at
            self.last[at] = ends
        for word, at in spelt.items():
            self.size[at] = len(word)
            self.automaton.add_word(word, at)
            self.shorter[at] = next((spelt[word[:k]] for k in range(len(word) - 1, 0, -1) if word[:k] in spelt), -1)
        self.automaton.make_automaton()
        self.sizes = np.array(self.size)
        self.most = max(self.size)
        self.known: dict[int, bool] = {}

    def _apart(self, a: int, b: int) -> bool:
        a_used = b_used = _NEVER
        while True:
            r = self.rank.get(a << 32 | b)
            if r is not None and r < a_used and r <= b_used:  # of two equal merges the left one fires first
                return False
            if self.born[a] >= self.born[b]:
                if self.born[a] < 0:
                    return True
                a_used, a = self.born[a], self.right[a]
            else:
                b_used, b = self.born[b], self.left[b]

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` side by side are the encoding of what they spell together."""
        pair = a << 32 | b
        answer = self.known.get(pair)
        if answer is None:
            if len(self.known) > 2_000_000:
                self.known.clear()
            answer = self.known[pair] = self._apart(a, b)
        return answer

    def walk(self, word: str, out: list[int] | None = None, token: int = -1) -> list[int]:
        """Tokens of one word whose last letter is marked; ``out`` may be a start of compatible tokens, then ``token`` is the next to try."""
        longest, most, shorter, size = self.automaton.iter_long, self.most, self.shorter, self.size
        known, compatible = self.known.get, self.compatible
        if not out:
            out, token = [], next(longest(word[:most]))[1]
        at, n, dead = sum([size[t] for t in out]), len(word), set()
        while True:
            if out:
                before = out[-1]
                while token >= 0:
                    fits = known(before << 32 | token)
                    if (compatible(before, token) if fits is None else fits) and at + size[token] not in dead:
                        break
                    token = shorter[token]
            else:
                while token >= 0 and size[token] in dead:
                    token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                if at == n:
                    return out
                token = next(longest(word[at : at + most]))[1]
            else:
                dead.add(at)
                token = out.pop()
                at -= size[token]
                token = shorter[token]

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian uint32) of pre-split words in byte-level letters, none empty."""
        marked = [as_last(w) for w in words]
        ends = np.cumsum([len(w) for w in words])
        found = np.array(list(self.automaton.iter_long("".join(marked))), np.int64).reshape(-1, 2)
        at, ids = found[:, 0] + 1, found[:, 1]
        if len(ids) == 0 or at[-1] != ends[-1] or (np.diff(at, prepend=0) != self.sizes[ids]).any():
            return [np.array(self.walk(w), "<u4").tobytes() for w in marked]
        owner = np.searchsorted(ends, at)
        inner = np.nonzero(owner[:-1] == owner[1:])[0]
        some, where = np.unique(ids[inner] << 32 | ids[inner + 1], return_inverse=True)
        fits = np.array([self.compatible(p >> 32, p & 0xFFFFFFFF) for p in some.tolist()], bool)
        begins = np.searchsorted(owner, np.arange(len(words) + 1))
        cuts, raw = (4 * begins).tolist(), ids.astype("<u4").tobytes()
        out = [raw[s:e] for s, e in zip(cuts, cuts[1:])]
        if len(some):
            bad = inner[~fits[where]]
            wrong, first = np.unique(owner[bad], return_index=True)
            for k, s, e in zip(wrong.tolist(), begins[wrong].tolist(), bad[first].tolist()):
                sound = ids[s : e + 2].tolist()  # all but the last stand side by side
                token = self.shorter[sound.pop()]
                out[k] = b"".join([t.to_bytes(4, "little") for t in self.walk(marked[k], sound, token)])
        return out


def as_last(word: str) -> str:
    """``word`` with its last letter marked as last."""
    return word[:-1] + chr(ord(word[-1]) + _LAST)


class Encoder:
    """Token ids of texts, as little-endian uint32; remembers up to ``most`` words, when full the half met first."""

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        self.merges = Merges(path)
        whole = Tokenizer.from_file(path)
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        self.apart = re.compile("|".join(map(re.escape, self.merges.special)) or r"(?!)")
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.most = most

    def _split(self, words: list[str]) -> list[tuple[str, ...]]:
        """Pieces of each word in byte-level letters; words hold no white space and no special token."""
        plain, other = [], []
        for k, w in enumerate(words):
            (plain if _PLAIN.fullmatch(w) else other).append(k)
        out: list[tuple[str, ...]] = [()] * len(words)
        if plain:
            # Printable ASCII is its own byte-level form and needs no normaliser but lower case.
            found = _PIECE.findall("\n".join([words[k] for k in plain]).lower())
            begin = 0
            for k in plain[:-1]:
                end = found.index("\n", begin)
                out[k] = tuple(found[begin:end])
                begin = end + 1
            out[plain[-1]] = tuple(found[begin:])
        if other:
            text = self.normalizer.normalize_str(" ".join([words[k] for k in other]))
            gaps = np.nonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 32)[0]
            if len(gaps) != len(other) - 1:  # not expected; each alone is always right
                for k in other:
                    out[k] = tuple(p for p, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(words[k])))
                return out
            found = self.splitter.pre_tokenize_str(text)
            owner = np.searchsorted(gaps, [s for _, (s, _) in found])
            cuts = np.searchsorted(owner, np.arange(len(other) + 1)).tolist()
            for k, s, e in zip(other, cuts, cuts[1:]):
                out[k] = tuple(p for p, _ in found[s:e])
        return out

    def _learn(self, new: list[str]) -> None:
        special = [w for w in new if self.apart.search(w)]
        plain = new
        if special:
            between = {p for w in special for p in self.apart.split(w) if p}
            plain = list(between.union(new).difference(special, self.words))
        split = self._split(plain)
        unmet = list({p for pieces in split for p in pieces}.difference(self.pieces))
        if unmet:
            self.pieces.update(zip(unmet, self.merges.encode(unmet), strict=True))
        known = self.pieces.__getitem__
        self.words.update((w, known(p[0]) if len(p) == 1 else b"".join(map(known, p))) for w, p in zip(plain, split, strict=True))
        for p in unmet:
            if len(p) > _LONGEST_KEPT:
                del self.pieces[p]
        for w in special:
            parts, at = [], 0
            for m in self.apart.finditer(w):
                parts += [self.words.get(w[at : m.start()], b""), self.merges.special[m[0]].to_bytes(4, "little")]
                at = m.end()
            self.words[w] = b"".join([*parts, self.words.get(w[at:], b"")])

    def _forget(self, new: list[str]) -> None:
        for w in new:
            if len(w) > _LONGEST_KEPT:
                self.words.pop(w, None)
        for memory in ("words", "pieces"):
            kept = getattr(self, memory)
            if len(kept) > self.most:
                setattr(self, memory, dict(islice(kept.items(), self.most // 2)))

    def _some(self, texts: list[str]) -> list[bytes]:
        split = [_WORD.findall(t) if _ODD_SPACE.search(t) else t.split() for t in texts]
        new = list(set().union(*split).difference(self.words))
        if new:
            self._learn(new)
        known = self.words.__getitem__
        out = [b"".join(map(known, words)) for words in split]
        if new:
            self._forget(new)
        return out

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for text in texts:
            if text and len(text) > _CUT:
                out.append(b"".join(self._some([part])[0] for part in _parts(text)))
            else:
                out.append(None)
        rest = self._some([t or "" for t, done in zip(texts, out, strict=True) if done is None])
        short = iter(rest)
        return [next(short) if done is None else done for done in out]


def _parts(text: str) -> Iterator[str]:
    """Stretches of a long text, cut before white space that both Python and the vocabulary take for it."""
    space, at = re.compile(r"[ \t\n\r]"), 0
    while at < len(text):
        cut = space.search(text, at + _CUT)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


class Decoder:
    """Texts of token ids: one blob of all tokens' text and the offsets of each in it."""

    def __init__(self, texts: list[str], between: str = " "):
        self.between = len(between.encode())
        self.table = pa.array([(t + between).encode() for t in texts], pa.large_binary())

    def __call__(self, ids: list[bytes]) -> list[bytes]:
        """UTF-8 of each list's tokens, joined."""
        sizes = np.array([len(x) // 4 for x in ids])
        taken = self.table.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1]
        data = memoryview(taken.buffers()[2] or b"")
        ends = offsets[np.cumsum(sizes)].tolist()
        return [bytes(data[s : max(s, e - self.between)]) for s, e in zip([0, *ends], ends)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def decoder(path: str) -> Decoder:
    return Decoder(encoder(path).merges.texts)


def _portions(batches: Iterator[pa.RecordBatch], bodies: int = 128, most: int = 4 << 20) -> Iterator[tuple[pa.Array, list]]:
    """First column and second column as a list, some rows at a time: as many as hold ``most`` bytes, one at least."""
    for batch in batches:
        at = 0
        while at < len(batch):
            n = min(bodies, len(batch) - at)
            while n > 1 and batch.column(1).slice(at, n).nbytes > most:
                n //= 2
            yield batch.column(0).slice(at, n), batch.column(1).slice(at, n).to_pylist()
            at += n


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in _portions(batches):
            yield pa.RecordBatch.from_arrays([keys, pa.array(encoder(path)(texts), pa.binary())], ["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids in _portions(batches):
            texts = decoder(path)([x or b"" for x in ids])
            yield pa.RecordBatch.from_arrays([keys, pa.array([t.decode() for t in texts], pa.string())], ["doc_id", "text"])

    return run


def encoded(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids`` (little-endian uint32) of every row; a null text counts as empty and has no ids.

    Strings of the vocabulary's special tokens become these tokens. Repeated rows, null ids
    and texts of any length give their row each; an empty table gives none.
    """
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_encode(vocabulary), "doc_id long, ids binary")


def decoded(ids: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, text`` of the result of ``encoded``: the tokens' texts with a blank between, as the vocabulary, which names no decoder, asks for. Null ids count as none."""
    return ids.select("doc_id", "ids").mapInArrow(_decode(vocabulary), "doc_id long, text string")


def digest(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: ``encoded`` and ``decoded`` in one pass, told by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = None
        for batch in _encode(vocabulary)(batches):
            ids = batch.column(1).to_pylist()
            numbers = numbers or Decoder([str(k) for k in range(len(encoder(vocabulary).merges.texts))])
            told = [[hashlib.sha256(x).hexdigest() for x in spell(ids)] for spell in (numbers, decoder(vocabulary))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), *map(pa.array, told)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
