"""Byte-level BPE over whole texts at the speed of a dictionary: pieces between spaces are encoded once.

In the pre-tokenizer of such vocabularies a space that a non-space follows always starts a pre-token,
and a lone line break between two non-spaces is one. Merges never cross pre-tokens. So a text whose white
space is single spaces and single line breaks (other white space may stand inside a piece) is the
concatenation of its pieces, each encoded on its own by the library and kept in a bounded dictionary; a line's
first piece is kept with the line break before it. Punctuation (no apostrophe) after a letter or digit starts a
pre-token too, so that a piece is its stem and its tail. Any other text, and any text with a special token's
string, or a piece that other white space begins or ends, goes to the library whole.
"""

from __future__ import annotations

import string
from functools import lru_cache

import numpy as np

#: Pieces that a worker keeps; at this number it starts again with an empty dictionary.
KEPT_PIECES = 400_000
#: Pieces that are encoded in one call; characters (about) whose pieces are looked up together, so that they stay in the cache.
BLOCK, TOGETHER = 200, 1 << 16
#: Tails of pieces: contractions begin with an apostrophe. Stems end below this character, where letters are letters in all versions of Unicode.
TAIL, STEM_END = string.punctuation.replace("'", ""), "\u0250"
#: The letter for a space in byte-level vocabularies, where ASCII letters stand for themselves.
SPACE = "\u0120"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _regular(text: str) -> bool:
    return not (
        "  " in text or "\n\n" in text or " \n" in text or "\n " in text
        or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n")
    )


class PieceEncoder:
    """ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kept = kept
        self.known: dict[str, bytes] = {}  # pieces after a space, and with the line break before it those at the start of a line
        self.tails: dict[str, bytes] = {}
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)  # ids whose tokens begin with a space
        self.spaced[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True
        self.marked = Tokenizer.from_file(path)  # for pieces of letters alone, in the vocabulary's own letters: one pre-token each
        self.marked.pre_tokenizer = pre_tokenizers.Split(SPACE, "merged_with_next")
        self.newline = self._encode(["\n"])[0]
        self.line = np.frombuffer(self.newline, "<u4")[0]

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> None:
        """New pieces are known afterwards, but the odd ones: those that other white space begins or ends."""
        known = self.known
        if len(known) + len(new) > self.kept:
            known.clear()
        new = [p for p in new if not (p[-1].isspace() or p[p[0] == "\n" :][:1].isspace())]
        stems = [stem if p[-1] in TAIL and (stem := p.rstrip(TAIL)) and stem[-1] < STEM_END and stem[-1].isalnum() else p for p in new]
        least = set(stems).difference(known)
        kinds: dict[str, list[str]] = {"\n": [], " ": [], SPACE: []}
        for p in least:
            kinds["\n" if p[0] == "\n" else SPACE if p.isascii() and p.isalpha() else " "].append(p)
        for lead, own in kinds.items():
            for k in range(0, len(own), BLOCK):
                known.update(zip(own[k : k + BLOCK], self._encode_block(own[k : k + BLOCK], lead), strict=True))
        if len(self.tails) > self.kept:
            self.tails = {}
        cut = [(p, stem, p[len(stem) :]) for p, stem in zip(new, stems, strict=True) if len(stem) < len(p)]
        tails = list({tail for _, _, tail in cut}.difference(self.tails))
        self.tails.update(zip(tails, self._encode(tails), strict=True))
        known.update([(p, known[stem] + self.tails[tail]) for p, stem, tail in cut])

    def _encode_block(self, pieces: list[str], lead: str) -> list[bytes]:
        """The pieces' ids from one call: pieces after a space part at tokens that begin with one, others at line breaks."""
        library, joined = (self.marked if lead == SPACE else self.library), "".join(pieces) if lead == "\n" else lead + lead.join(pieces)
        ids = np.array(library.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        starts = np.flatnonzero(ids == self.line if lead == "\n" else self.spaced[ids])
        if len(starts) != len(pieces):
            return self._encode([p if lead == "\n" else " " + p for p in pieces])
        data, cuts = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def ids(self, texts: list[str]) -> list[bytes]:
        out, part, size = [], [], 0
        for text in texts:
            part.append(text)
            size += len(text)
            if size >= TOGETHER:
                out += self._ids(part)
                part, size = [], 0
        return out + self._ids(part)

    def _ids(self, texts: list[str]) -> list[bytes]:
        get, new = self.known.get, set()
        cut: list[list[bytes | None] | None] = []
        open_: list[tuple[int, list[int], list[str]]] = []  # texts with new pieces: where these are, and which
        for text in texts:
            if not text or not _regular(text) or any(s in text for s in self.special):
                cut.append(None)
                continue
            own = text.replace("\n", " \n").split(" ")
            own[0] = "\n" + own[0]
            found = list(map(get, own))
            if None in found:
                at = [i for i, ids in enumerate(found) if ids is None]
                own = [own[i] for i in at]
                new.update(own)
                open_.append((len(cut), at, own))
            cut.append(found)
        self._learn(new)
        get = self.known.get
        for k, at, own in open_:
            found = cut[k]
            for i, ids in zip(at, map(get, own), strict=True):
                found[i] = ids
            if None in found:
                cut[k] = None
        whole = iter(self._encode([t for t, c in zip(texts, cut, strict=True) if t and c is None]))
        skip = len(self.newline)
        return [b"".join(c)[skip:] if c else next(whole) if t else b"" for t, c in zip(texts, cut, strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder a worker and vocabulary."""
    return PieceEncoder(path)
