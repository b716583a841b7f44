"""BPE encoding and decoding by a prefix-sharing trie.

In byte-pair encoding each prefix of a word has one encoding, and its last token is the one
token that ends there, is a vocabulary entry, and stands unmerged after the encoding of what
lies before it.  The distinct words of a batch go into a trie; a depth-first walk computes one
last-token state a node, so a prefix that many words share is encoded once.  A word's ids are
read back along the states.

The tokenizer file is a parameter (the public tokenizers package on every executor by default);
nothing is trained and nothing is copied.  Special-token strings in a text become their ids, as
the tokenizers library does.

Nulls: a null text is empty.  Empty texts have no tokens (empty ids, empty decoded text).  Texts
of any length are encoded whole.  Rows are mapped one by one: repeats, ties and null ids stay as
they are, an empty table gives no rows, further columns are carried through by encode().
"""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import small_batches, table, trimmed

#: Distinct words a worker remembers between batches; beyond it the memory is emptied, which costs time only.
REMEMBERED = 200_000
#: Characters of text that are handled at a time.
STEP_CHARS = 1_500_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


#: For texts within Latin-1 the file's classes are these (after lower case); a plain engine then cuts words several times faster.
LATIN_1 = {"L": "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff", "N": "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "S": "\\x09-\\x0d \u0085\u00a0"}


class WordBpe:
    """Encoder and decoder of a word-level BPE file: NFC, lower case, words by the file's pattern, byte letters, word-end suffix."""

    def __init__(self, path: str):
        import re

        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end: str = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        strings = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.table = [strings.get(i, "") for i in range(max(strings) + 1)]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # \\s of the library is Unicode white space; spelled out, as \\s of Python's engines also takes U+001C to U+001F
        self.word = regex.compile(split.replace("\\s", "\\p{White_Space}"))
        self.narrow = re.compile(split.replace("\\p{L}", LATIN_1["L"]).replace("\\p{N}", LATIN_1["N"]).replace("\\s", LATIN_1["S"]))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = byte_letters()
        # merges: rank of a pair, and of each token the pair it comes from
        self.pair: dict[int, int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(model["merges"]):
            x, y = m if isinstance(m, list) else m.split(" ")
            i, j = self.ids[x], self.ids[y]
            self.pair[i << 20 | j] = r
            self.made.setdefault(self.ids[x + y], (r, i, j))
        self.stands: dict[int, bool] = {}
        self.edges: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self.known: dict[str, bytes] = {}
        self._automaton()

    # -- words of a text

    def words(self, text: str) -> list[str]:
        text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()  # one code point is lowered at a time in the library: no final sigma
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.word.findall(text)
        return self.narrow.findall(text)

    def pieces(self, text: str) -> list[str | int]:
        """Words, and the ids of special tokens that stand in the text."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.words(text)
        out: list[str | int] = []
        for part in self.cut.split(text):
            out += [self.special[part]] if part in self.special else self.words(part)
        return out

    # -- which tokens end where: states are the vocabulary's prefixes, found as the walk needs them

    def _automaton(self) -> None:
        self.inner = {t: i for t, i in self.ids.items() if not t.endswith(self.end)}
        self.final = {t[: -len(self.end)]: i for t, i in self.ids.items() if t.endswith(self.end)}
        self.prefixes = {t[:k] for v in (self.inner, self.final) for t in v for k in range(1, len(t) + 1)}
        self.state_of = {"": 0}
        self.state_text = [""]
        self.go: list[dict[str, int]] = [{}]
        self.ends_inner: list[list[tuple[int, int]]] = [[]]
        self.ends_final: list[list[tuple[int, int]]] = [[]]
        self.length = {i: len(t) for t, i in self.inner.items()} | {i: len(t) for t, i in self.final.items()}

    def step(self, state: int, letter: str) -> int:
        """The state of the longest vocabulary prefix that ends with this letter."""
        text = self.state_text[state] + letter
        while text and text not in self.prefixes:
            text = text[1:]
        nxt = self.state_of.get(text)
        if nxt is None:
            nxt = self.state_of[text] = len(self.state_text)
            self.state_text.append(text)
            self.go.append({})
            tails = [text[k:] for k in range(len(text))]  # longest first
            self.ends_inner.append([(self.inner[t], len(t)) for t in tails if t in self.inner])
            self.ends_final.append([(self.final[t], len(t)) for t in tails if t in self.final])
        self.go[state][letter] = nxt
        return nxt

    # -- which tokens stand side by side

    def edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """(part, rank of the merge that takes it in) along a token's right or left edge, from the single symbol up."""
        got = self.edges.get((token, right))
        if got is None:
            made, gone, got = self.made.get(token), 1 << 60, []
            at = token
            while True:
                got.append((at, gone))
                if made is None:
                    break
                gone, at = made[0], made[2 if right else 1]
                made = self.made.get(at)
            self.edges[token, right] = got = got[::-1]
        return got

    def unmerged(self, left: int, right: int) -> bool:
        """Whether left and right, one after the other, encode as just these two tokens.

        While both grow from single symbols, the parts at the border change as merges take them in; the
        pair falls if a merge across the border comes before those that take its parts in (of equal
        ranks the left one comes first).
        """
        a, b = self.edge(left, True), self.edge(right, False)
        i = j = 0
        while True:
            (x, x_gone), (y, y_gone) = a[i], b[j]
            rank = self.pair.get(x << 20 | y)
            if rank is not None and rank < x_gone and rank <= y_gone:
                return False
            if x_gone <= y_gone:
                if i + 1 == len(a):
                    return True
                i += 1
            else:
                j += 1

    # -- encoding

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids (little-endian unsigned 32-bit) of distinct words, by one depth-first walk of their trie."""
        letters, out = self.letters, {}
        children: list[dict[str, int]] = [{}]
        ends: dict[int, str] = {}
        for word in words:
            node = 0
            for letter in word if word.isascii() and word.isprintable() else [letters[b] for b in word.encode("utf-8")]:
                step = children[node]
                node = step.get(letter, 0)
                if not node:
                    node = step[letter] = len(children)
                    children.append({})
            ends[node] = word
        stands, go, ends_inner = self.stands, self.go, self.ends_inner
        if len(stands) > 400_000:
            stands.clear()
        states = [0]  # last token of each prefix of the path
        stack = [(n, c, 1, 0) for c, n in children[0].items()]
        while stack:
            node, letter, depth, at = stack.pop()
            del states[depth:]
            at = go[at].get(letter) or self.step(at, letter)
            below = children[node]
            if below:
                for token, size in ends_inner[at]:
                    if size == depth:
                        break  # the whole prefix is a token that its own merges make
                    key = states[depth - size] << 20 | token
                    good = stands.get(key)
                    if good is None:
                        good = stands[key] = self.unmerged(states[depth - size], token)
                    if good:
                        break
                else:
                    raise ValueError(f"no token ends {self.state_text[at]!r}")
                states.append(token)
                depth += 1
                for c, n in below.items():
                    stack.append((n, c, depth, at))
                depth -= 1
            word = ends.get(node)
            if word is not None:
                out[word] = self._read(states, depth, at)
        return out

    def _read(self, states: list[int], depth: int, at: int) -> bytes:
        """The ids of the word that ends here: its last token, then back along the states."""
        for token, size in self.ends_final[at]:
            if size == depth:
                break
            key = states[depth - size] << 20 | token
            good = self.stands.get(key)
            if good is None:
                good = self.stands[key] = self.unmerged(states[depth - size], token)
            if good:
                break
        else:
            raise ValueError(f"no token ends {self.state_text[at]!r}")
        ids, depth = [token], depth - size
        while depth > 0:
            token = states[depth]
            ids.append(token)
            depth -= self.length[token]
        ids.reverse()
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        pieces = [self.pieces(t) for t in texts]
        seen = {w for p in pieces for w in p if type(w) is str}
        new = seen.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = seen
        self.known.update(self.encode_words(new))
        for i in self.special.values():
            self.known[i] = struct.pack("<I", i)  # type: ignore[index]
        known = self.known.__getitem__
        return [b"".join(map(known, p)) for p in pieces]

    # -- decoding

    def decode(self, ids: bytes) -> str:
        """Token strings, special ones included, with a space between: the file names no decoder."""
        return " ".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def model(path: str) -> WordBpe:
    return WordBpe(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def steps(texts: list[str | None], chars: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts of about so many characters."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """docs without the text, with ids (in place of a column of that name): binary, little-endian unsigned 32-bit."""
    docs = docs.drop("ids")
    small_batches(docs.sparkSession)
    where = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(where)
        try:
            yield from encoded(bpe, batches)
        finally:
            bpe.known.clear()
            bpe.stands.clear()  # workers outlive tasks, and memory is theirs and the other stages'

    def encoded(bpe: WordBpe, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            rest = batch.select([n for n in batch.schema.names if n != text])
            texts = batch.column(at).to_pylist()
            for s, e in steps(texts):
                ids = bpe.encode([t or "" for t in texts[s:e]])
                part = rest.slice(s, e - s)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], names=[*part.schema.names, "ids"])

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes if n != text)
    return docs.mapInArrow(trimmed(run), f"{fields}, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with the column decoded beside ids."""
    encoded = encoded.drop("decoded")
    where = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(where)
        for batch in batches:
            all_ids = batch.column(batch.schema.get_field_index("ids"))
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                out = [bpe.decode(i or b"") for i in all_ids.slice(s, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], names=[*part.schema.names, "decoded"])

    fields = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)
    return encoded.mapInArrow(run, f"{fields}, decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    both = decode(encode(docs.select("doc_id", "text"), path), path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
