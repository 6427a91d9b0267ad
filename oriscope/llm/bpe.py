"""BPE encoding and decoding by prefix-sharing trie traversal.

Texts are cut at ASCII white space, which a word-level tokenizer drops; each distinct piece is normalised and split
into words once. The distinct words go into a trie, whose nodes are prefixes. Walking it depth first, each node gets
the last token of its prefix's encoding and the node where that token starts; so a prefix that many words share is
encoded once, and a word's tokens are read off by following the links back.

That the last token is enough rests on this: two tokens can stand side by side exactly if merging their joined
symbols ends in these two, and a sequence is the encoding of its text exactly if all neighbours can.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oriscope.llm._shared import give_back, slices

NEVER = 1 << 40


def _longest(tokens: dict[str, int]) -> dict[str, int]:
    out: dict[str, int] = {}
    for t in tokens:
        out[t[-2:]] = max(out.get(t[-2:], 1), len(t))
    return out


class Merges:
    """Which tokens can be neighbours, from a tokenizer file's vocabulary and merges."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right, whole = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank.setdefault((left, right), rank)
            self.parts.setdefault(whole, (left, right, rank))
        self.edges: tuple[dict[int, list], dict[int, list]] = {}, {}
        self.known: dict[int, bool] = {}
        # Tokens that merging can give: within a word, and at its end (without the suffix). By a token's last two
        # characters: the most characters of such a token.
        self.inner, self.final = {}, {}
        for token, i in self.ids.items():
            if self.whole(i):
                stem = token.removesuffix(self.end)
                (self.inner if len(stem) == len(token) else self.final)[stem] = i
        self.reach = tuple(_longest(x) for x in (self.inner, self.final))

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols that stand at the token's left (0) or right (1) edge while it is merged together, each with
        the rank of the merge that takes it away."""
        if (found := self.edges[side].get(token)) is None:
            found, x, gone = [], token, NEVER
            while True:
                found.append((x, gone))
                if x not in self.parts:
                    break
                gone = self.parts[x][2]
                x = self.parts[x][side]
            found.reverse()
            self.edges[side][token] = found
        return found

    def fit(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when their symbols are merged side by side.

        Ranks are times. A symbol at a's right edge and one at b's left edge are merged if the rank of that merge
        comes before either is taken away; at equal rank the leftmost merge comes first.
        """
        key = a << 20 | b
        if (known := self.known.get(key)) is not None:
            return known
        left, right, i, j, apart = self._edge(a, 1), self._edge(b, 0), 0, 0, True
        while True:
            (x, x_gone), (y, y_gone) = left[i], right[j]
            across = self.rank.get((x, y), NEVER)
            if across < x_gone and across <= y_gone and across < NEVER:
                apart = False
                break
            if x_gone == NEVER and y_gone == NEVER:
                break
            if x_gone <= y_gone:
                i += 1
            else:
                j += 1
        if len(self.known) > 2_000_000:
            self.known.clear()
        self.known[key] = apart
        return apart

    def whole(self, token: int) -> bool:
        """Whether merging a token's own symbols gives the token."""
        key = -1 - token
        if (known := self.known.get(key)) is None:
            known = token not in self.parts or self.whole(self.parts[token][0]) and self.whole(self.parts[token][1]) and self._joins(token)
            self.known[key] = known
        return known

    def _joins(self, token: int) -> bool:
        a, b, rank = self.parts[token]
        saved = self.rank.pop((a, b))
        try:
            self.known.pop(a << 20 | b, None)
            return self.fit(a, b)
        finally:
            self.rank[a, b] = saved
            self.known.pop(a << 20 | b, None)
            del rank


class PrefixTrie:
    """The trie of some words in the tokenizer's byte alphabet, walked depth first.

    Nodes are numbered as the walk enters them. Sorted words come in the order of the walk, and what a word shares with
    the one before is the part of the way that the walk need not leave: so children need not be stored.
    """

    def __init__(self, merges: Merges):
        self.m = merges
        self.token, self.back = array("i", [-1]), array("i", [-1])

    def encode_all(self, words: list[str]) -> dict[str, list[int]]:
        """Token ids of each word."""
        m, token, back = self.m, self.token, self.back
        inner, inner_reach, final, final_reach = m.inner.get, m.reach[0].get, m.final.get, m.reach[1].get
        known, fit = m.known.get, m.fit
        out: dict[str, list[int]] = {}
        path, before = [0], ""
        for word in sorted(set(words)):
            last = len(word) - 1
            shared, top = 0, min(last, len(path) - 1)
            while shared < top and word[shared] == before[shared]:
                shared += 1
            del path[shared + 1 :]
            before = word
            for end in range(shared + 1, last + 1):
                # The only token that ends here and can follow the last token before it.
                for start in range(max(0, end - inner_reach(word[max(0, end - 2) : end], 1)), end):
                    if (t := inner(word[start:end])) is not None:
                        at = path[start]
                        if not at or ((ok := known(token[at] << 20 | t)) or ok is None and fit(token[at], t)):
                            break
                else:
                    raise ValueError(f"no token of the vocabulary ends {word[:end]!r}")
                path.append(len(token))
                token.append(t)
                back.append(at)
            end = last + 1
            for start in range(max(0, end - final_reach(word[-2:], 1)), end):
                if (t := final(word[start:])) is not None:
                    at = path[start]
                    if not at or ((ok := known(token[at] << 20 | t)) or ok is None and fit(token[at], t)):
                        break
            else:
                raise ValueError(f"no token of the vocabulary ends {word!r}")
            ids = [t]
            while at:
                ids.append(token[at])
                at = back[at]
            ids.reverse()
            out[word] = ids
        return out


class Encoder:
    """Encodes texts, remembering distinct pieces within a bounded memory. One lives in each Python worker."""

    def __init__(self, spec: str, max_pieces: int = 150_000):
        from tokenizers import Tokenizer

        self.spec = json.loads(spec)
        tokenizer = Tokenizer.from_str(spec)
        self.normalise, self.split = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.merges, self.max_pieces = Merges(self.spec), max_pieces
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.names = {i: t for t, i in (*self.merges.ids.items(), *self.special.items())}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        # Most pieces are letters and then ASCII punctuation. Both stay whole in the split, and letters up to U+012F are
        # in composed form and have one lower-case letter each, so that such pieces need no library call.
        letters = [chr(i) for i in range(0x130) if chr(i).isalpha()]
        self.plain = re.compile("([" + "".join(letters) + r"]*)([!-&(-/:;=?@\[-`{-~]*)")
        self.small = {ord(c): "".join(w for w, _ in self.split.pre_tokenize_str(c.lower())) for c in letters}
        self.empty()

    def empty(self) -> None:
        self.pieces, self.words = _Pieces(), {}
        self.ids, self.starts, self.decoded = array("I"), array("q", [0]), []
        self.seen = np.zeros(0, np.int64)

    def forget(self) -> None:
        """Drop the pieces that were met once; all, if too many are left."""
        again = np.flatnonzero(self.seen > 1)
        names, old_ids, old_starts, old_decoded = list(self.pieces), self.ids, self.starts, self.decoded
        self.empty()
        if len(again) > self.max_pieces * 2 // 3:
            return
        for at in again.tolist():
            self.pieces[names[at]] = len(self.decoded)
            self.ids.extend(old_ids[old_starts[at] : old_starts[at + 1]])
            self.starts.append(len(self.ids))
            self.decoded.append(old_decoded[at])
        self.seen = np.zeros(len(again), np.int64)

    def _words(self, piece: bytes) -> list[str | int]:
        """A piece's words in the byte alphabet; special tokens as their ids."""
        text = piece.decode("utf-8")
        if found := self.plain.fullmatch(text):
            letters, rest = found.groups()
            return [w for w in (letters.translate(self.small), rest) if w]
        out: list[str | int] = []
        for part in self.cut.split(text) if self.cut and "<" in text else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += [w for w, _ in self.split.pre_tokenize_str(self.normalise.normalize_str(part))]
        return out

    def learn(self) -> None:
        """Encode the pieces that were met since the last call."""
        fresh = [self._words(p) for p in self.pieces.fresh]
        self.pieces.fresh.clear()
        words = self.words
        words |= PrefixTrie(self.merges).encode_all([w for each in fresh for w in each if w.__class__ is str and w not in words])
        names = self.names
        for each in fresh:
            ids = words[each[0]] if len(each) == 1 and each[0].__class__ is str else [i for w in each for i in (words[w] if w.__class__ is str else (w,))]
            self.ids.extend(ids)
            self.starts.append(len(self.ids))
            self.decoded.append(" ".join([names[i] for i in ids]).encode())

    def encode(self, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, bytes]]:
        """Token ids and decoded text (UTF-8) of each text."""
        held: list[np.ndarray] = []
        for text in texts:
            pieces = (text or b"").split()
            held.append(np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces)))
            if len(self.pieces.fresh) > 50_000:
                yield from self._flush(held)
        yield from self._flush(held)

    def _flush(self, held: list[np.ndarray]) -> Iterator[tuple[np.ndarray, bytes]]:
        self.learn()
        ids, starts = np.array(self.ids, np.uint32), np.array(self.starts, np.int64)
        for at in held:
            n = starts[at + 1] - starts[at]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            found = ids[np.repeat(starts[at] - ends + n, n) + np.arange(total)]
            yield found, b" ".join([d for d in map(self.decoded.__getitem__, at.tolist()) if d])
        if held:
            met = np.bincount(np.concatenate(held), minlength=len(self.pieces))
            met[: len(self.seen)] += self.seen
            self.seen = met
        held.clear()
        if len(self.pieces) > self.max_pieces:
            self.forget()


class _Pieces(dict):
    """Numbers pieces as they are met."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self.fresh.append(piece)
        self[piece] = n = len(self)
        return n


_encoders: dict[str, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec)
    return _encoders[key]


FIELDS = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def encode_texts(docs: DataFrame, tokenizer: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), fields: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """`keep` columns and the given FIELDS for each row of docs.

    tokenizer: path of a tokenizer file on the driver: BPE with an end-of-word suffix, white space dropped, no decoder
    (decoded text is the tokens, joined by spaces). Special tokens in a text become their ids. A null or empty text has
    no tokens. Rows are independent; nothing shuffles.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    rows = docs.select(F.col(text_col).alias("_text"), *(F.col(f"`{c}`") for c in keep))
    make = {
        "n_tokens": (pa.int64(), lambda ids, text: len(ids)),
        "ids": (pa.list_(pa.int32()), lambda ids, text: ids.astype(np.int32)),
        "ids_sha256": (pa.string(), lambda ids, text: hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()),
        "decoded": (pa.string(), lambda ids, text: text.decode()),
        "decoded_sha256": (pa.string(), lambda ids, text: hashlib.sha256(text).hexdigest()),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in slices(batches):
            out: dict[str, list] = {f: [] for f in fields}
            for ids, text in encoder.encode(batch.column(0).cast(pa.binary()).to_pylist()):
                for f, column in out.items():
                    column.append(make[f][1](ids, text))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(v, make[f][0]) for f, v in out.items())], [*batch.schema.names[1:], *fields])
        encoder.empty()  # the worker may have other work next
        give_back()

    schema = rows.drop("_text").select("*", *(F.lit(None).cast(FIELDS[f]).alias(f) for f in fields)).schema
    return rows.mapInArrow(run, schema)
