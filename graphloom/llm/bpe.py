"""BPE encoding and decoding with a contiguous rank array (operator 4).

A word is a row of part ids with the merge ranks of adjacent parts beside it. The row is scanned for
its smallest rank, the boundary there is deleted, and the two neighbouring ranks are refreshed, until no
pair has a rank. Many short words are worked on at once, a matrix row each; longer words keep their
boundaries in a linked list with a heap of ranks, which gives the same merges. Words come from the
tokenizer file's own steps: special tokens, NFC, lower case, and its splitting pattern.

Defined results: null text is empty; an empty text has no tokens and decodes to the empty string;
doc_ids pass through, null or repeated; an empty table gives an empty one; extra columns are dropped.
Letters and marks younger than the library's tables are treated as the library treats them.
Each worker keeps up to CACHE words with their tokens; beyond that the memory starts anew.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.frames import pick, read

SHORT, CACHE = 32, 300_000
NONE = np.iinfo(np.int32).max
# White space as the tokenizer's pattern means it (Unicode White_Space).
_SPACE = r"\t-\r \x85\xa0  -     　"
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
# Combining marks younger than the tokenizers library's normaliser, starters to it, and the
# second half of a composition that it does not know.
STARTERS = (
    "\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b-\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c"
    "\U00010d24-\U00010d27\U00010eab-\U00010eac\U00010efd-\U00010eff\U00010f46-\U00010f50\U00010f82-\U00010f85\U00011070\U0001133b\U0001145e"
    "\U00011839-\U0001183a\U00011930\U0001193d-\U0001193e\U00011943\U000119e0\U00011a34\U00011a47\U00011a99\U00011d42\U00011d44-\U00011d45\U00011d97"
    "\U00011f41-\U00011f42\U00016ff0-\U00016ff1\U0001e08f\U0001e130-\U0001e136\U0001e2ae\U0001e2ec-\U0001e2ef\U0001e4ec-\U0001e4ef"
)
# Capitals younger than Python's tables that the library lower-cases.
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7DC: 0x019B} | {c: c + 1 for c in (0xA7CC, 0xA7CE, 0xA7D2, 0xA7D4, 0xA7DA)}
LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_STARTER = re.compile(f"([{STARTERS}])")


# What the regex module calls letters and digits and the library, whose tables are older, does not.
YOUNGER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf"
    "\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f"
    "\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U00016ff4-\U00016ff6"
    "\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2"
    "\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_YOUNGER = re.compile(f"[{YOUNGER}]")
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
#: The same for texts that hold some of these.
_OLDER_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|(?:(?![{YOUNGER}])\p{{L}})+|(?![{YOUNGER}])\p{{N}}|(?:[{YOUNGER}]|[^{_SPACE}\p{{L}}\p{{N}}])+")


_ODD = re.compile(f"[{STARTERS}{YOUNGER}{''.join(map(chr, LOWER))}]")


def _plain(text: str) -> str:
    """NFC and lower case; the library lower-cases letter by letter, without the final sigma."""
    text = unicodedata.normalize("NFC", text)
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


def normalised(text: str) -> str:
    """NFC and lower case as the tokenizers library has them."""
    pieces = [unicodedata.normalize("NFC", x) for x in _STARTER.split(text)]
    return "".join(c.lower() for c in "".join(pieces)).translate(LOWER)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + other.index(b)) for b in range(256)]


class WordBpe:
    """A tokenizer file of words with an end mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.end] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in reversed(list(enumerate(pairs)))}
        keys = np.array([(a << 20) | b for a, b in self.ranks], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        both = np.array(list(self.ranks.values()), np.int64)[order]
        self.rank_of, self.merged = both[:, 0].astype(np.int32), both[:, 1]
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, tuple[int, str, str]] = {}

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each adjacent pair (NONE if it has none) and the id it merges to; a negative id is no part."""
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.rank_of[at], NONE), self.merged[at]

    def short_words(self, words: list[bytes]) -> list[list[int]]:
        """Part ids of words of up to SHORT bytes, all at once."""
        width = max(map(len, words))
        parts = np.full((len(words), width + 1), -1, np.int64)
        for i, w in enumerate(words):
            raw = np.frombuffer(w, np.uint8)
            parts[i, : len(w)] = self.inner[raw]
            parts[i, len(w) - 1] = self.last[raw[-1]]
        ranks, into = self._look(parts[:, :-1], parts[:, 1:])
        rows, column = np.arange(len(words)), np.arange(width + 1)
        live = rows[ranks.min(1) < NONE]
        while len(live):
            r, p, m = ranks[live], parts[live], into[live]
            at = r.argmin(1)
            here = np.arange(len(live))
            p[here, at] = m[here, at]
            step = column[None, :] + (column[None, :] > at[:, None])
            p = np.take_along_axis(np.hstack((p, np.full((len(live), 1), -1))), step, 1)
            step = step[:, :-1]
            pad = np.full((len(live), 1), NONE, r.dtype)
            r = np.take_along_axis(np.hstack((r, pad)), step, 1)
            m = np.take_along_axis(np.hstack((m, pad)), step, 1)
            for side in (at - 1, at):
                ok = side >= 0
                q, s = here[ok], side[ok]
                ok2 = s < width
                q, s = q[ok2], s[ok2]
                r[q, s], m[q, s] = self._look(p[q, s], p[q, s + 1])
            parts[live], ranks[live], into[live] = p, r, m
            live = live[r.min(1) < NONE]
        return [row[row >= 0].tolist() for row in parts]

    def long_word(self, word: bytes) -> list[int]:
        """The same merges, smallest rank and leftmost first, with a heap."""
        ids = [int(self.inner[b]) for b in word[:-1]] + [int(self.last[word[-1]])]
        n = len(ids)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*self.ranks[p], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.ranks]
        heap = [(r, i, new, a, b) for r, new, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = nxt[i] if ids[i] >= 0 else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            for x in (prev[i], i):
                if x >= 0 and nxt[x] < n and (p := (ids[x], ids[nxt[x]])) in self.ranks:
                    r, made = self.ranks[p]
                    heapq.heappush(heap, (r, x, made, *p))
        return [i for i in ids if i >= 0]

    def split(self, text: str) -> list[str]:
        """Words and special tokens of a text, in order."""
        out: list[str] = []
        for piece in self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]:
            if piece in self.special:
                out.append(piece)
            elif piece.isascii():
                out += _ASCII_WORDS.findall(piece.lower())
            else:
                odd = _ODD.search(piece)  # one look for all that Python and the library see differently
                piece = normalised(piece) if odd else _plain(piece)
                out += (_OLDER_WORDS if odd and _YOUNGER.search(piece) else _WORDS).findall(piece)
        return out

    def learn(self, words: set[str]) -> None:
        """Put the words' tokens into memory: (number, ids as text, tokens as text)."""
        if len(self.known) + len(words) > CACHE:
            self.known = {}
        new = [w for w in words if w not in self.known]
        raw = [w.encode() for w in new]
        done: list[list[int] | None] = [[self.special[w]] if w in self.special else None for w in new]
        by_size: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            if done[i] is None:
                by_size.setdefault((len(b) + 3) // 4 if len(b) <= SHORT else 0, []).append(i)
        for size, at in by_size.items():
            for k in range(0, len(at), 4096):
                part = at[k : k + 4096]
                made = self.short_words([raw[i] for i in part]) if size else [self.long_word(raw[i]) for i in part]
                for i, ids in zip(part, made, strict=True):
                    done[i] = ids
        for w, ids in zip(new, done, strict=True):
            self.known[w] = len(ids), " ".join(map(str, ids)), " ".join([self.tokens[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        words = self.split(text)
        self.learn(set(words))
        return [int(i) for w in words for i in self.known[w][1].split()]

    def decode(self, ids: list[int]) -> str:
        """As the file says: no decoder, tokens joined by a space."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


@lru_cache(maxsize=2)
def tokenizer(name: str) -> WordBpe:
    """The tokenizer of this worker; name is a path, or a file of the installed vocabularies."""
    if "/" in name:
        return WordBpe(name)
    import public_tokenizers

    return WordBpe(public_tokenizers.path(name))


def encode_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256 over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                split = [bpe.split(t or "") for t in part.column(1).to_pylist()]
                bpe.learn(set().union(*split))
                known = bpe.known
                counts, ids, decoded = [], [], []
                for words in split:
                    n, i, d = zip(*[known[w] for w in words], strict=True) if words else ((), (), ())
                    counts.append(sum(n))
                    ids.append(hashlib.sha256(" ".join(i).encode()).hexdigest())
                    decoded.append(hashlib.sha256(" ".join(d).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text of documents."""
    return encode_documents(read(spark, sf_dir, "documents"))
