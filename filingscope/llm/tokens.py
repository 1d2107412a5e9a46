"""Public vocabularies, encoded segment by segment where that provably gives the whole text's ids."""

from __future__ import annotations

import base64
import re

import numpy as np

#: Segments kept per worker and vocabulary.
KEPT = 400_000
SPECIAL = "<|endoftext|>"
_open: dict = {}


def opened(kind, name: str):
    """One encoder per worker process and vocabulary."""
    if (kind, name) not in _open:
        _open[kind, name] = kind(name)
    return _open[kind, name]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


class ByteBpe:
    """The ids of a byte-level BPE (name.json of tokenizers, name.tiktoken as ranks).

    The pattern that cuts a text before merging never lets a cut-out cross the place before a space
    that a non-space follows: what stands before is left alone by what comes after. So a text's ids
    are those of its segments, cut there; known segments are looked up, new ones encoded together.
    A text with the special string goes to tokenizers whole.
    """

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = vocabulary(name)
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path.removesuffix(".json") + ".tiktoken", "rb"))}
        self.ordinary = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.whole = Tokenizer.from_file(path)
        self.lengths = np.zeros(max(ranks.values()) + 2, np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        self.kept: dict[str, bytes] = {}

    def segments(self, text: str) -> list[str]:
        if re.search(r" \s", text) or text.endswith(" "):
            return re.split(r"(?= \S)", text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        plain = [SPECIAL not in t for t in texts]
        cut = [self.segments(t) if ok else [] for t, ok in zip(texts, plain)]
        if len(self.kept) > KEPT:
            self.kept.clear()
        known, out = self.kept, []
        for text, ok, parts in zip(texts, plain, cut):
            if not ok:
                out.append(np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            if new := [x for x in set(parts) if x not in known]:
                self.learn(new)
            out.append(b"".join(map(known.__getitem__, parts)))
        return out

    def learn(self, new: list[str]) -> None:
        spaced = [x for x in new if x[:1] == " " and x[1:2].strip()]
        for x in new:
            if not (x[:1] == " " and x[1:2].strip()):
                self.kept[x] = np.array(self.ordinary(x), "<u4").tobytes()
        if spaced:
            ids = np.array(self.ordinary("".join(spaced)), "<u4")
            ends = np.cumsum(self.lengths[ids])
            stops = np.searchsorted(ends, np.cumsum([len(x.encode()) for x in spaced])) + 1
            flat, at = ids.tobytes(), 0
            for x, stop in zip(spaced, (stops * 4).tolist()):
                self.kept[x] = flat[at:stop]
                at = stop


class Pieces:
    """Ids of a sentencepiece BPE model with byte fallback.

    No piece of the vocabulary has a space mark after another character (checked when it is opened),
    so no merge crosses the place before a run of spaces: a text's ids are those of its segments, each
    a run of spaces and what follows up to the next. The mark that stands before a whole text is the
    first space of its first segment.
    """

    def __init__(self, name: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(name))
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any(re.search("[^▁]▁", x) for x in names):
            raise ValueError(f"{name}: pieces cross spaces, segments are not independent")
        self.byte = np.array([self.model.is_byte(i) for i in range(len(names))])
        self.kept: dict[str, bytes] = {}

    def segments(self, text: str) -> list[str]:
        """Without the space that encode() puts before each. A mark in a text is to the model what a space is."""
        text = text.replace("▁", " ")
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return [x[1:] for x in re.findall(" +[^ ]*", " " + text)] if text else []
        return text.split(" ") if text else []

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.kept) > KEPT:
            self.kept.clear()
        known = self.kept
        cut = [self.segments(t) for t in texts]
        if new := [x for x in set().union(*cut) if x not in known]:
            # a lone mark is what the library makes of a space, but not of an empty text
            for x, ids in zip(new, self.model.encode([x or "x" for x in new], num_threads=1)):
                known[x] = np.array(ids if x else [self.model.piece_to_id("▁")], "<u4").tobytes()
        return [b"".join(map(known.__getitem__, parts)) for parts in cut]

    def boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Stable places of a text (before a run of spaces, after another character) and the tokens before each."""
        self.encode([text])
        parts = self.segments(text)
        counts = [len(self.kept[x]) // 4 for x in parts]
        starts = np.cumsum([0] + [len(x) + 1 for x in parts])[:-1] - 1
        before = np.cumsum([0] + counts)[:-1]
        return starts[1:], before[1:]
