"""BPE by backtracking over longest token matches.

An Aho-Corasick automaton of the vocabulary gives the longest token that starts
at a place. The encoder walks left to right with the longest match, keeps a token
only if it is compatible with the one before it (the pair could not have been
merged, or split differently, by the merge ranks), and else tries the next
shorter token or goes back one token; a bit per place marks dead ends, so every
place is given up at most once and the work is linear in the word. The result is
the exact merge result. Decoding reads token texts from one buffer through an
offset table.

The tokenizer file is a parameter (``tokenizers`` JSON of a byte-level BPE with
an end-of-word suffix); its pre-tokenisation (normal form, white space, lower
case, split pattern, added tokens) is rebuilt from the file's own settings.
Defined results: null text is empty and has no tokens. An extra column with the
name of a result column gives way to it.
"""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, plus, prepare, ranges, sha256_hex, text_slices

MAX_CACHED_WORDS = 60_000     # a generation of the cache (some 400 bytes a word)
MAX_CACHED_LENGTH = 64        # longer words are encoded each time
MAX_CACHED_PAIRS = 80_000
SLICE = 1 << 20              # text bytes encoded at a time
LATIN = 0x180           # below this code point all Unicode versions agree
BLANKS = "\\x09-\\x0d\\x20\\x85\\xa0"   # white space below it


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the
    others follow from U+0100 on in byte order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    out.update({b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in out)})
    return out


class _Cache(dict):
    """Memory of a function over two generations: a full one becomes the old one,
    so what is met often stays and at most twice ``limit`` entries are held. Text keys
    above ``longest`` characters aren't held."""

    def __init__(self, function, limit: int, longest: int = 0):
        super().__init__()
        self.function, self.limit, self.longest, self.old = function, limit, longest, {}

    def __missing__(self, key):
        if self.longest and len(key) > self.longest:
            return self.function(key)
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Bpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, spec: dict):
        import re

        import ahocorasick

        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self._check(spec)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self._classes(split)
        self.split_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None

        texts = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        blob = [texts.get(i, "").encode() for i in range(max(texts) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in blob])]).astype(np.int64)
        self.buffer = np.frombuffer(b"".join(blob), dtype=np.uint8)
        self._bytes, self._at, self._packed = b"".join(blob), self.offsets.tolist(), struct.Struct("<i").pack

        # symbols: byte b is chr(b); the last byte of a word, with the suffix, chr(256 + b)
        alphabet = byte_alphabet()
        self.base = {}
        for b, c in alphabet.items():
            self.base[chr(b)] = vocab[c]
            self.base[chr(256 + b)] = vocab[c + self.suffix]
        size = max(vocab.values()) + 1
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size    # -1: a single symbol
        self.pairs = {}                                                               # (left, right) -> rank of their merge
        symbols = {i: s for s, i in self.base.items()}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            ia, ib, ic = vocab[a], vocab[b], vocab[a + b]
            self.rank[ic], self.left[ic], self.right[ic], self.pairs[ia, ib] = r, ia, ib, r
            symbols[ic] = symbols[ia] + symbols[ib]
        # a token that its own merges never make can't be in any result
        self.reach = set(self.base.values())
        for i in sorted((i for i in symbols if self.rank[i] >= 0), key=self.rank.__getitem__):
            if self.left[i] in self.reach and self.right[i] in self.reach and self.compatible(self.left[i], self.right[i], self.rank[i]):
                self.reach.add(i)
        by_symbols = {symbols[i]: i for i in self.reach}
        self.forward = ahocorasick.Automaton()
        for s, i in by_symbols.items():
            self.forward.add_word(s, i)
        self.forward.make_automaton()
        self.shorter = [-1] * (max(symbols) + 1)     # the longest token that a token begins with
        self.length = [0] * (max(symbols) + 1)
        for s, i in by_symbols.items():
            self.length[i] = len(s)
            for k in range(len(s) - 1, 0, -1):
                if (j := by_symbols.get(s[:k])) is not None:
                    self.shorter[i] = j
                    break
        self.pair_ok = _Cache(lambda pair: self.compatible(*pair), MAX_CACHED_PAIRS)
        # word -> its ids (4 bytes each, low byte first), in decimals, decoded
        self.words = _Cache(lambda word: self._piece(self.encode_word(word)), MAX_CACHED_WORDS, MAX_CACHED_LENGTH)
        self._spec, self._library = {k: v for k, v in spec.items() if k != "model"}, None

    def _classes(self, split: str) -> None:
        """The split pattern for ``re``: for Latin text its letter and digit
        classes are written out; other text goes to the tokenizers library's own
        splitter, whose Unicode version decides what a letter is."""
        import re

        latin = [chr(c) for c in range(LATIN)]
        kinds = {k: "".join(re.escape(c) for c in latin if unicodedata.category(c)[0] == k) for k in "LN"}
        own = split.replace("[\\p{L}]", f"[{kinds['L']}]").replace("[\\p{N}]", f"[{kinds['N']}]")
        own = own.replace("[^\\s\\p{L}\\p{N}]", f"[^{BLANKS}{kinds['L']}{kinds['N']}]")
        if "\\p" in own:
            raise ValueError(f"unsupported split pattern: {split}")
        self.find_words = re.compile(own).findall
        self.foreign = re.compile(f"[^\\x00-\\x1b\\x20-{chr(LATIN - 1)}]").search

    def _check(self, spec: dict) -> None:
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or spec["model"]["type"] != "BPE" or spec.get("decoder"):
            raise ValueError(f"unsupported tokenizer settings: {steps}")

    def compatible(self, a: int, b: int, limit: int = 1 << 60) -> bool:
        """Would ``a`` and ``b`` side by side stay two tokens? Undo the later of
        the two sides' merges again and again; at each seam no pair may merge
        before the merges that are still done."""
        rank, left, right, pairs = self.rank, self.left, self.right, self.pairs
        while True:
            r = pairs.get((a, b))
            if r is not None and r < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra > rb:          # a was made later: before that, its right half stood here
                limit, a = ra, right[a]
            elif rb < 0:         # two single symbols
                return True
            else:                # on a tie both were made by the same merge, left one first
                limit, b = rb + 1, left[b]

    def encode_symbols(self, word: str) -> list[int]:
        """The merge result. Longest matches from left to right are tried first: a
        row of tokens is the result exactly if every neighbour pair is compatible."""
        ok = self.pair_ok
        out = [i for _, i in self.forward.iter_long(word)]
        if all(map(ok.__getitem__, zip(out, out[1:]))) and sum(map(self.length.__getitem__, out)) == len(word):
            return out
        return self._backtrack(word)

    def _backtrack(self, word: str) -> list[int]:
        n, matches = len(word), self.forward.iter_long
        longest: dict[int, int] = {}                # of the places come to: the first match from there on
        length, shorter, ok = self.length, self.shorter, self.pair_ok
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, next(matches(word))[1]
        while at < n:
            while True:
                end = at + length[token]
                if alive[end] and (not out or ok[out[-1], token]):
                    out.append(token)
                    at = end
                    if at < n:
                        token = longest.get(at, -1)
                        if token < 0:
                            token = longest[at] = next(matches(word, at))[1]
                    break
                token = shorter[token]
                if token < 0:                    # dead end: give this place up and go back
                    alive[at] = 0
                    token = out.pop()
                    at -= length[token]
                    break
        return out

    def encode_word(self, word: str) -> list[int]:
        if not word.isascii():
            word = word.encode().decode("latin-1")
        return self.encode_symbols(word[:-1] + chr(256 + ord(word[-1])))

    def _piece(self, ids: list[int]) -> tuple[bytes, str, bytes]:
        """Ids, decimals and decoded text (through the offset table) of a few tokens."""
        buffer, at = self._bytes, self._at
        return b"".join([self._packed(i) for i in ids]), " ".join(map(str, ids)), b" ".join([buffer[at[i]:at[i + 1]] for i in ids])

    def _plain_pieces(self, text: str) -> Iterator[tuple[bytes, str, bytes]]:
        """Normal form (NFC, lower case letter by letter), split, merges. White-space
        runs needn't become one blank first: no alternative of the split pattern
        matches a blank, they only part words."""
        if self.foreign(text):
            words = self._library_words(text)
        else:
            words = self.find_words((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())
        return map(self.words.__getitem__, words)

    def _library_words(self, text: str) -> list[str]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(json.dumps(self._spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []}))
            back = {c: b for b, c in byte_alphabet().items()}
            self._to_byte = lambda s: bytes(back[c] for c in s).decode()
        t = self._library
        return [self._to_byte(w) for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))]

    def pieces(self, text: str) -> list[tuple[bytes, str, bytes]]:
        """The text's pieces in order: ids, decimals and decoded text of each."""
        parts = self.split_added(text) if self.split_added else [text]
        if len(parts) == 1:
            out = list(self._plain_pieces(text))
        else:
            out = []
            for k, part in enumerate(parts):
                out.extend([self._piece([self.added[part]])] if k % 2 else self._plain_pieces(part))
        return [p for p in out if p[0]]                  # a run may hold no token

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(b"".join([p[0] for p in self.pieces(text)]), "<i4").tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        """Token texts joined by one blank, gathered through the offset table; so the decoded
        text of a document is that of its pieces, joined by one blank."""
        n = len(ids)
        if n == 0:
            return b""
        start = self.offsets[ids]
        size = self.offsets[ids + 1] - start
        begin = np.cumsum(size + 1) - size - 1          # where each token goes
        out = np.full(int(begin[-1] + size[-1]), 32, dtype=np.uint8)
        out[ranges(begin, size)] = self.buffer[ranges(start, size)]
        return out.tobytes()


_LOADED: dict[int, Bpe] = {}


def loaded(spec: bytes) -> Bpe:
    """The encoder of a tokenizer file, built once in each Python worker."""
    key = hash(spec)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(json.loads(spec))
    return _LOADED[key]


def load_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def encode_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``docs`` plus ids (array<int>) and decoded (the decoded text). The tokenizer
    file is read on the driver and sent to the tasks (its size is the vocabulary's)."""
    spark = prepare(docs)
    with open(tokenizer_path, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    docs = docs.drop("ids", "decoded")                       # the results take these names
    base = [f.name for f in docs.schema.fields]
    schema = plus(docs.schema, ids="array<int>", decoded="string")
    df = docs.withColumn("_b_text", as_bytes("text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(sent.value)
        for batch in batches:
            for part, texts in text_slices(batch, "_b_text", SLICE):
                pieces = [bpe.pieces(t.decode("utf-8", "replace")) if t else [] for t in texts]
                ids = [b"".join([p[0] for p in x]) for x in pieces]
                decoded = [b" ".join([p[2] for p in x]) for x in pieces]
                off = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                cols = [part.column(k) for k in range(len(base))] + [flat, pa.array(decoded, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[*base, "ids", "decoded"])

    return df.mapInArrow(emit, schema)


def encode_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``docs`` without its text, plus n_tokens, ids_sha256 (decimal ids joined by
    one blank) and decoded_sha256: what a corpus check needs, at a few bytes a row."""
    spark = prepare(docs)
    with open(tokenizer_path, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    base = [f.name for f in docs.schema.fields if f.name not in ("text", "n_tokens", "ids_sha256", "decoded_sha256")]
    df = docs.select(*base, as_bytes("text").alias("_b_text"))
    schema = plus(docs.select(*base).schema, n_tokens="long", ids_sha256="string", decoded_sha256="string")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(sent.value)
        for batch in batches:
            for part, texts in text_slices(batch, "_b_text", SLICE):
                pieces = [bpe.pieces(t.decode("utf-8", "replace")) if t else [] for t in texts]
                cols = [part.column(k) for k in range(len(base))]
                cols += [pa.array([sum([len(p[0]) for p in x]) // 4 for x in pieces], pa.int64()),
                         pa.array([sha256_hex(" ".join([p[1] for p in x]).encode()) for x in pieces], pa.string()),
                         pa.array([sha256_hex(b" ".join([p[2] for p in x])) for x in pieces], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=[*base, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.mapInArrow(emit, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 beside the columns of ``encode_documents``."""
    return encoded.withColumns({
        "n_tokens": F.size("ids").cast("long"),
        "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256),
        "decoded_sha256": F.sha2("decoded", 256),
    })
