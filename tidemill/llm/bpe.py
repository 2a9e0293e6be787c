"""BPE encoding by backtracking over Aho-Corasick matches, and decoding by an offset table.

A word's encoding is the unique token sequence whose neighbours are all compatible: a pair is compatible when merging
by rank would never join across their border. The encoder takes the longest token at a position (from one pass of an
Aho-Corasick automaton over the word), tests it against the token before in the pair-compatibility table, falls back
to the token's next shorter prefix token, and otherwise steps back over the last token, marking the position as dead,
so that each position is given up once and the work stays linear in the word's length.

The vocabulary file is the JSON of a public tokenizer whose normaliser is NFC, white space to one space, lower case,
and whose words end with a suffix; its path is a parameter and is read on the driver, and what the tasks need (under
4 MB) is broadcast: its size is the vocabulary's, not the corpus's.

Defined results: null and empty texts have no tokens; texts are never cut; repeated rows each give a row; strings of
the special tokens in a text become those tokens.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .text import chunks

#: White space as the vocabulary's own normaliser has it.
_WHITE = r"\t-\r \x85\xa0  -     　"
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WHITE}\p{{L}}\p{{N}}]+")
#: Bytes of runs between white space and of words, and pairs, that a worker remembers between texts and tasks; what comes
#: beyond is worked out anew each time, and so is a run of more than LONG_RUN characters.
CACHE_RUN_BYTES = 40 << 20
CACHE_WORD_BYTES = 12 << 20
CACHE_PAIRS = 150_000
LONG_RUN = 64
#: Bytes that a remembered string and its ids take besides their letters.
ENTRY = 210
#: Separators of str.split that the vocabulary doesn't take for white space.
_NOT_WHITE = "\x1c\x1d\x1e\x1f"


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Tokens in order of merge rank, their parts, and the tables of the encoder and decoder."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        rank = {a + b: i for i, (a, b) in enumerate(merges)}
        base = [t for t in vocab if t not in rank]
        order = [*base, *rank]
        place = {t: i for i, t in enumerate(order)}
        self.ids = [vocab[t].to_bytes(4, "little") for t in order]
        # left and right part by place; a base token is its own part
        self.left = list(range(len(base))) + [place[a] for a, _ in merges]
        self.right = list(range(len(base))) + [place[b] for _, b in merges]
        self.joined = {(place[a], place[b]): place[a + b] for a, b in merges}
        self.letters = _byte_letters()
        keys = [self._key(t) for t in order]
        self.length = [len(k) for k in keys]
        by_key = {k: i for i, k in enumerate(keys)}
        self.shorter = [next((by_key[k[:n]] for n in range(len(k) - 1, 0, -1) if k[:n] in by_key), -1) for k in keys]
        self.automaton = ahocorasick.Automaton()
        for k, i in by_key.items():
            self.automaton.add_word(k, (len(k), i))
        self.automaton.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        parts = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.buffer = np.frombuffer(b"".join(parts), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.runs: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.run_room, self.word_room = CACHE_RUN_BYTES, CACHE_WORD_BYTES
        self.pairs: dict[tuple[int, int], bool] = {}

    def _key(self, token: str) -> str:
        """The token with its word end, if any, as one character that no byte letter uses."""
        return token[: -len(self.suffix)] + "\n" if token.endswith(self.suffix) else token

    def compatible(self, a: int, b: int) -> bool:
        """Whether a then b can stand side by side: no merge across the border comes before theirs."""
        known = self.pairs.get((a, b))
        if known is None:
            known = self._compatible(a, b)
            if len(self.pairs) < CACHE_PAIRS:
                self.pairs[a, b] = known
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # Undo the later of the two merges that made a and b, step by step; a join across the border that ranks before
        # what was undone last would have been made first. On equal rank the left pair merges first.
        limit = len(self.ids)
        while True:
            if self.joined.get((a, b), limit) < limit:
                return False
            if a > b:
                inner, other = self.right[a], self.left[b]
                if inner != a:
                    limit, a = a, inner
                elif other != b:
                    limit, b = b + 1, other
                else:
                    return True
            else:
                inner, other = self.left[b], self.right[a]
                if inner != b:
                    limit, b = b + 1, inner
                elif other != a:
                    limit, a = a, other
                else:
                    return True

    def _encode_word(self, word: str) -> bytes:
        letters = self.letters
        s = (word if word.isascii() and word.isprintable() else "".join([letters[b] for b in word.encode()])) + "\n"
        n = len(s)
        length, shorter, known, compatible = self.length, self.shorter, self.pairs.get, self.compatible
        # The longest matches one after the other are the path up to the first two that don't fit each other.
        out: list[int] = []
        at, last, token = 0, -1, -1
        for end, (size, token) in self.automaton.iter_long(s):
            if end - at + 1 != size:  # no token starts here
                token = -1
                break
            if last >= 0:
                fits = known((last, token))
                if not (compatible(last, token) if fits is None else fits):
                    token = shorter[token]
                    break
            out.append(token)
            at += size
            last = token
        else:
            token = -1
        if at < n:
            alive = bytearray(b"\x01") * (n + 1)
        while at < n:
            while token >= 0:
                if alive[at + length[token]]:
                    fits = known((last, token))
                    if last < 0 or (compatible(last, token) if fits is None else fits):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                last, token = token, self._longest(s, at) if at < n else -1
            else:
                if not out:
                    raise ValueError(f"the vocabulary can't spell {word!r}")
                alive[at] = 0
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1
        return b"".join([self.ids[t] for t in out])

    def _longest(self, s: str, at: int) -> int:
        """The longest token that starts at a place of s, -1 for none."""
        for end, (size, token) in self.automaton.iter_long(s, at):
            return token if end - size + 1 == at else -1
        return -1

    def word_ids(self, word: str) -> bytes:
        """The ids of one word as little-endian unsigned 32-bit integers."""
        known = self.words.get(word)
        if known is None:
            known = self._encode_word(word)
            if self.word_room > 0 and len(word) <= LONG_RUN:
                self.words[word] = known
                self.word_room -= ENTRY + len(word) + len(known)
        return known

    def encode(self, text: str) -> bytes:
        """The ids of a text, little-endian unsigned 32-bit."""
        if any(map(text.__contains__, self.special)):
            return b"".join(
                self.special[part].to_bytes(4, "little") if part in self.special else self._encode_plain(part)
                for part in self.split.split(text)
            )
        return self._encode_plain(text)

    def _encode_plain(self, text: str) -> bytes:
        if any(map(text.__contains__, _NOT_WHITE)):
            return self._encode_run(text)
        known, ids = self.runs, self.run_ids  # no word reaches across white space
        return b"".join([known.get(r) or ids(r) for r in text.split()])

    def run_ids(self, run: str) -> bytes:
        """The ids of a run of characters that aren't white space."""
        known = self.runs.get(run)
        if known is None:
            known = self._encode_run(run)
            if self.run_room > 0 and len(run) <= LONG_RUN:
                self.runs[run] = known
                self.run_room -= ENTRY + len(run) + len(known)
        return known

    def _encode_run(self, text: str) -> bytes:
        if not (text.isascii() or unicodedata.is_normalized("NFC", text)):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")  # lower-cased letter by letter, without the final form
        words = _WORD.findall(text.lower())
        if len(words) == 1 and words[0] == text:  # the run is a word, and is remembered as a run
            return self._encode_word(text)
        known, ids = self.words, self.word_ids
        return b"".join([known.get(w) or ids(w) for w in words])

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 text of ids: the tokens with a space between two, gathered from one buffer by offset."""
        if not len(ids):
            return b""
        start, size = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        end = np.cumsum(size)
        return self.buffer[np.arange(end[-1]) + np.repeat(start - (end - size), size)][:-1].tobytes()


@lru_cache(maxsize=2)
def _vocabulary(source: str) -> Vocabulary:
    return Vocabulary(source)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens long, ids binary, decoded string) for every row of docs (doc_id, text).

    ids holds little-endian unsigned 32-bit integers; decoded is what decoding them gives.
    """
    with open(path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _vocabulary(source.value)
        for batch in chunks(batches, "text", 1 << 20):
            ids = [vocab.encode(t) if t else b"" for t in batch.column("text").to_pylist()]
            decoded = [vocab.decode(np.frombuffer(i, "<u4").astype(np.int64)) for i in ids]
            counts = pa.array([len(i) // 4 for i in ids], pa.int64())
            columns = [batch.column("doc_id"), counts, pa.array(ids, pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return small_batches(rows).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of round_trip's rows."""
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
