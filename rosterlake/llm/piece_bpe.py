"""Merge-type BPE over code points (SentencePiece models) by a prefix table.

The text gets one leading mark and its blanks become marks. Any two neighbour
pieces whose joined text is in the vocabulary may merge, best score first, then
leftmost. A row of pieces is the result of that exactly if no two neighbours would
merge otherwise (the merges inside a stretch go the same way whether or not the
stretch has surroundings, as long as none crosses its ends). So every prefix has
one last piece: the piece, among all automaton matches that end there, that is
compatible with the last piece of the prefix before it. The table of last pieces is
filled from left to right and the ids are read from it backwards.

Compatibility walks the two pieces' own merge trees back in time; pieces whose
merges don't come in falling order of score (blank runs of equal score) are tried
by merging their joined text. Characters that the vocabulary lacks become byte
pieces and nothing merges across them; no piece holds a mark after another
character, so runs that begin at a mark are encoded (and remembered) by themselves.

The model file is a parameter; it is read on the driver and its table (bounded by
the vocabulary) is sent to the tasks. Models that normalise, hold user-defined or
unused pieces or lack byte pieces are refused.

Defined results: a null text is an empty text, which has the begin and end ids only
and decodes to an empty text. Rows are handled one by one, so repeated rows give
repeated results. A column with the name of a result column gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import _Cache
from .common import as_bytes, plus, prepare, ranges, sha256_hex, text_slices

MARK = "▁"
MAX_CACHED_RUNS = 150_000     # a generation of the memory of runs
MAX_CACHED_PAIRS = 200_000
MAX_CACHED_LENGTH = 64        # longer runs are encoded each time
SHORT_LINE = 256              # lines up to this hold no run worth looking for
SLICE = 1 << 20               # text bytes encoded at a time
_RUN = re.compile(" *[^ ]+| +")


def read_model(path: str) -> dict:
    """The table of a model file: pieces, scores, kinds and the special ids."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(path, "rb") as f:
        model = pb.ModelProto.FromString(f.read())
    kinds = [p.type for p in model.pieces]
    own = pb.ModelProto.SentencePiece
    norm, train = model.normalizer_spec, model.trainer_spec
    plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces
    if not plain or train.model_type != pb.TrainerSpec.BPE or not train.byte_fallback or train.treat_whitespace_as_suffix:
        raise ValueError(f"unsupported model settings: {path}")
    if own.USER_DEFINED in kinds or own.UNUSED in kinds:
        raise ValueError(f"user-defined or unused pieces aren't supported: {path}")
    return {
        "pieces": [p.piece for p in model.pieces], "scores": [p.score for p in model.pieces],
        "normal": [k == own.NORMAL for k in kinds], "control": [k == own.CONTROL for k in kinds],
        "bytes": {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == own.BYTE},
        "unknown": train.unk_id, "unknown_text": train.unk_surface, "begin": train.bos_id, "end": train.eos_id,
    }


def merge(symbols: list[str], score: dict[str, float]) -> list[str]:
    """The definition: the best-scored neighbour pair merges, the leftmost of equals."""
    out = list(symbols)
    while len(out) > 1:
        best, at = None, -1
        for i in range(len(out) - 1):
            s = score.get(out[i] + out[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if best is None:
            break
        out[at:at + 2] = [out[at] + out[at + 1]]
    return out


def prepared(model: dict) -> dict:
    """``model`` with each piece's last own merge, and which pieces the merges reach."""
    pieces, normal = model["pieces"], model["normal"]
    score = {p: s for p, s, ok in zip(pieces, model["scores"], normal, strict=True) if ok}
    ids = {p: i for i, p in enumerate(pieces) if normal[i]}
    chars = {p for p in ids if len(p) == 1}
    if any(c not in chars for p in ids for c in p):
        raise ValueError("a piece holds a character that is no piece")
    if any(MARK in p.lstrip(MARK) for p in ids):
        raise ValueError("a piece holds a mark after another character")
    left, right, reach = [-1] * len(pieces), [-1] * len(pieces), []
    for p, i in ids.items():
        if len(p) == 1:
            reach.append(i)
            continue
        parts = list(p)
        while len(parts) > 2:                       # the state before the last merge
            step = merge_once(parts, score)
            if step is None:
                break
            parts = step
        if len(parts) == 2:
            left[i], right[i] = ids[parts[0]], ids[parts[1]]
            reach.append(i)
    shared = {s for s, n in _counts(score.values()).items() if n > 1}
    falling = [False] * len(pieces)                 # merges come in falling order of unshared scores
    for i in sorted(reach, key=lambda i: len(pieces[i])):
        a, b = left[i], right[i]
        falling[i] = a < 0 or falling[a] and falling[b] and model["scores"][i] not in shared and all(
            left[c] < 0 or model["scores"][c] > model["scores"][i] for c in (a, b))
    return model | {"left": left, "right": right, "reach": reach, "falling": falling}


def merge_once(parts: list[str], score: dict[str, float]) -> list[str] | None:
    found = [(score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in score]
    if not found:
        return None
    k = -max(found)[1]
    return [*parts[:k], parts[k] + parts[k + 1], *parts[k + 2:]]


def _counts(values) -> dict:
    out: dict = {}
    for v in values:
        out[v] = out.get(v, 0) + 1
    return out


class PieceBpe:
    """Encoder and decoder of one model."""

    def __init__(self, model: dict):
        import ahocorasick

        self.pieces, self.left, self.right, self.falling = model["pieces"], model["left"], model["right"], model["falling"]
        normal, scores = model["normal"], model["scores"]
        self.score = {p: s for p, s, ok in zip(self.pieces, scores, normal, strict=True) if ok}
        # a single character is there from the start
        self.made = [float("inf") if a < 0 else s for a, s in zip(self.left, scores, strict=True)]
        self.length = [len(p) for p in self.pieces]
        self.chars = {self.pieces[i] for i in model["reach"] if self.length[i] == 1}
        self.unknown = re.compile("([^" + "".join(map(re.escape, sorted(self.chars))) + "])").split
        self.byte_ids = model["bytes"]
        self.matches = ahocorasick.Automaton()
        for i in model["reach"]:
            self.matches.add_word(self.pieces[i], i)
        self.matches.make_automaton()
        self.pair_ok = _Cache(lambda pair: self.compatible(*pair), MAX_CACHED_PAIRS)
        as_ids = lambda text: np.array(self.encode_run(text), "<u4").tobytes()
        self.bare = _Cache(as_ids, MAX_CACHED_RUNS)                        # a line's run without a mark
        self.marked = _Cache(lambda word: as_ids(MARK + word), MAX_CACHED_RUNS)
        self.begin, self.end = (np.array([model[k]], "<u4").tobytes() for k in ("begin", "end"))
        self.line_end = np.array(self.encode_run("\n"), "<u4").tobytes()

        texts = [b"" if model["control"][i] else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        self.is_byte = np.zeros(len(texts), bool)
        for b, i in self.byte_ids.items():
            texts[i], self.is_byte[i] = bytes([b]), True
        texts[model["unknown"]] = model["unknown_text"].encode()
        self.leads = [normal[i] and p.startswith(MARK) for i, p in enumerate(self.pieces)]
        self.silent = model["control"]
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        self.buffer = np.frombuffer(b"".join(texts), dtype=np.uint8)

    def compatible(self, a: int, b: int) -> bool:
        """Would ``a`` and ``b`` side by side stay two pieces?"""
        pieces, score = self.pieces, self.score
        if not (self.falling[a] and self.falling[b]):
            return merge(list(pieces[a] + pieces[b]), score) == [pieces[a], pieces[b]]
        made, left, right = self.made, self.left, self.right
        gone_a = gone_b = float("-inf")         # when the merges that use up a, b come
        while True:
            s = score.get(pieces[a] + pieces[b])
            if s is not None and s > gone_a and s >= gone_b:      # of equals the leftmost: inside a, here, inside b
                return False
            if made[a] < made[b] or made[a] == made[b] and left[a] >= 0:
                if left[a] < 0:
                    return True
                # of two equal merges the left one came first, so b is undone before a
                if made[a] == made[b]:
                    gone_b, b = made[b], left[b]
                else:
                    gone_a, a = made[a], right[a]
            elif left[b] < 0:
                return True
            else:
                gone_b, b = made[b], left[b]

    def _last_pieces(self, text: str) -> list[int]:
        """The prefix table: by place, the last piece of the prefix that ends there."""
        last, length, ok = [-1] * (len(text) + 1), self.length, self.pair_ok
        for place, piece in self.matches.iter(text):
            end = place + 1
            if last[end] < 0:
                begin = end - length[piece]
                if not begin or last[begin] >= 0 and ok[last[begin], piece]:
                    last[end] = piece
        return last

    def _known(self, text: str) -> list[int]:
        last, out, at = self._last_pieces(text), [], len(text)
        while at:
            out.append(last[at])
            at -= self.length[last[at]]
        out.reverse()
        return out

    def encode_run(self, text: str) -> list[int]:
        if self.chars.issuperset(text):
            return self._known(text)
        out: list[int] = []
        for k, part in enumerate(self.unknown(text)):
            if k % 2:
                out.extend(self.byte_ids[b] for b in part.encode())
            elif part:
                out.extend(self._known(part))
        return out

    def encode(self, text: str) -> bytes:
        """The ids between the begin and end ids, each as 4 bytes, low byte first."""
        out = [self.begin]
        if text:
            for k, line in enumerate((" " + text.replace(MARK, " ")).split("\n")):
                if k:
                    out.append(self.line_end)
                if "  " in line or line.endswith(" ") or len(line) > SHORT_LINE and max(map(len, line.split(" "))) > MAX_CACHED_LENGTH:
                    for run in _RUN.findall(line):
                        out.append(self._any_run(run))
                elif line:
                    first, *rest = line.split(" ")
                    if first:
                        out.append(self.bare[first])
                    out.extend(map(self.marked.__getitem__, rest))
        out.append(self.end)
        return b"".join(out)

    def _any_run(self, run: str) -> bytes:
        if len(run) <= MAX_CACHED_LENGTH and not run.startswith("  ") and run != " ":
            return self.marked[run[1:]] if run[0] == " " else self.bare[run]
        return np.array(self.encode_run(run.replace(" ", MARK)), "<u4").tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """Piece texts gathered through the offset table; the first piece's leading
        mark goes, and bytes that are no UTF-8 become U+FFFD one by one."""
        first = 0
        while first < len(ids) and self.silent[ids[first]]:
            first += 1
        if first == len(ids):
            return b""
        start = self.offsets[ids]
        out = self.buffer[ranges(start, self.offsets[ids + 1] - start)].tobytes()
        if self.leads[ids[first]]:
            out = out[1:]
        if self.is_byte[ids].any():
            try:
                out.decode()
            except UnicodeDecodeError:
                return self._decode_loose(ids, self.leads[ids[first]])
        return out

    def _decode_loose(self, ids: np.ndarray, cut: bool) -> bytes:
        parts, raw = [], b""
        for i in [*ids.tolist(), -1]:
            if i >= 0 and self.is_byte[i]:
                raw += self.buffer[self.offsets[i]:self.offsets[i + 1]].tobytes()
                continue
            while raw:                     # whole characters, else one byte at a time
                n = next((n for n in range(1, 5) if _is_char(raw[:n])), 0)
                parts.append(raw[:n] if n else "�".encode())
                raw = raw[n or 1:]
            if i >= 0:
                parts.append(self.buffer[self.offsets[i]:self.offsets[i + 1]].tobytes())
        out = b"".join(parts)
        return out[1:] if cut else out


def _is_char(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


_LOADED: dict[int, PieceBpe] = {}


def _loaded(sent) -> PieceBpe:
    """The encoder of a broadcast table, built once in each Python worker."""
    key = hash(sent)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PieceBpe(sent.value)
    return _LOADED[key]


def _mapped(docs: DataFrame, model_path: str, fields: dict[str, str], columns) -> DataFrame:
    """``docs`` without its text columns plus ``fields``, which ``columns`` makes of
    the id bytes of a slice."""
    spark = prepare(docs)
    sent = spark.sparkContext.broadcast(prepared(read_model(model_path)))
    kept = [f.name for f in docs.schema.fields if f.name not in ("_b_text", *fields)]
    df = docs.select(*(f"`{c}`" for c in kept), "_b_text")
    schema = plus(docs.select(*(f"`{c}`" for c in kept)).schema, **fields)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _loaded(sent)
        for batch in batches:
            for part, texts in text_slices(batch, "_b_text", SLICE):
                ids = [coder.encode(t.decode("utf-8", "replace") if t else "") for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in range(len(kept))), *columns(coder, ids)], names=[*kept, *fields])

    return df.mapInArrow(emit, schema)


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """``docs`` plus ids (array<int>, with begin and end ids) and decoded (string)."""
    def columns(coder: PieceBpe, ids: list[bytes]) -> list[pa.Array]:
        off = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
        flat = pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(ids), "<i4")))
        return [flat, pa.array([coder.decode(np.frombuffer(x, "<i4")).decode() for x in ids], pa.string())]

    return _mapped(docs.withColumn("_b_text", as_bytes("text")), model_path, {"ids": "array<int>", "decoded": "string"}, columns)


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """``docs`` without its text plus n_tokens, ids_sha256 (ids as little-endian
    unsigned 32-bit integers) and decoded_sha256."""
    def columns(coder: PieceBpe, ids: list[bytes]) -> list[pa.Array]:
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha256_hex(x) for x in ids], pa.string()),
                pa.array([sha256_hex(coder.decode(np.frombuffer(x, "<i4"))) for x in ids], pa.string())]

    return _mapped(docs.withColumn("_b_text", as_bytes("text")).drop("text"), model_path,
                   {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, columns)
