"""Ids of a tokenizer file, one piece of text at a time: each distinct piece is encoded by the tokenizers library and kept."""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .shared import give_back, kept

#: Pieces of text a worker keeps with their ids, in each of two generations, and the longest kept, in characters.
KEPT_PIECES, LONGEST_KEPT = 1 << 18, 48
_LETTER, _OTHER = "A-Za-zÀ-ÖØ-öø-ÿ", "\\x00-@\\[-`{-\\x7f"
#: Pieces of a text that have the same ids alone and side by side. Byte-level BPE always starts anew where a letter is
#: followed by an ASCII character that is none, and where a printable ASCII character is followed by white space; what
#: stands before such a place has no say in what follows. Runs of letters come first, since they are most of a text.
PIECE = re.compile(rf" ?[{_LETTER}]++(?![^{_OTHER}])|[!-@\[-`{{-~]+(?=[ \n\t\r])|[\s\S]+?(?:(?<=[{_LETTER}])(?=[{_OTHER}])|(?<=[!-~])(?=[ \n\t\r])|\Z)")


#: A piece that can be a line of a text of many: letters, with a space before them at most.
LINE = re.compile(rf" ?[{_LETTER}]+")


class _Pieces(dict):
    """Ids of pieces in two generations: when the younger is full it becomes the older, and pieces still in use move over. missed: pieces asked for that neither has."""

    def __init__(self):
        super().__init__()
        self.old, self.missed = {}, {}

    def __missing__(self, piece: str):
        ids = self.old.get(piece)
        if ids is None:
            self.missed[piece] = None
        else:
            self[piece] = ids
        return ids

    def turn(self) -> None:
        if len(self) > KEPT_PIECES:
            self.old = dict(self)
            self.clear()

    def keep(self) -> None:
        self.update((x, b) for x, b in self.missed.items() if len(x) <= LONGEST_KEPT)
        self.missed.clear()


def splits_apart(setup: dict) -> bool:
    """Whether a tokenizer file (as JSON) encodes pieces apart: byte-level BPE with its usual split, no normalizer, and added tokens without spaces that take none beside them."""
    before, added = setup["pre_tokenizer"] or {}, setup.get("added_tokens") or []
    plain = setup["model"]["type"] == "BPE" and not setup["model"].get("dropout") and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
    return bool(plain and not setup["normalizer"] and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s", a["content"]) for a in added))


def encoder(path: str):
    """encode(texts) -> each text's ids by the tokenizer file, without special tokens, as little-endian unsigned 32-bit bytes.

    A text is cut into pieces whose ids do not depend on each other where the file's split allows it; pieces not met yet go
    to the tokenizers library in one batch. Other files encode whole texts. An added token's string is that token.
    """
    if kept.get("path") != path or "apart" not in kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        setup = json.loads(tok.to_str())
        kept.update(path=path, tok=tok, apart=splits_apart(setup), added=[a["content"] for a in setup.get("added_tokens") or []], ids=_Pieces(), line=tok.encode("\n", add_special_tokens=False).ids[0])
        give_back()
    line = LINE.fullmatch
    tok, pieces, added = kept["tok"], kept["ids"], kept["added"]

    def whole(texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def lines(words: list[str]) -> list[bytes]:
        """Runs of letters, as lines of one text: a line's end is one id that no letters give."""
        ids = np.array(tok.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids, "<u4") if words else np.zeros(0, "<u4")
        edge = np.concatenate([[-1], np.flatnonzero(ids == kept["line"]), [len(ids)]])
        data, at = ids.tobytes(), (4 * edge).tolist()
        return [data[a + 4 : b] for a, b in zip(at[:-1], at[1:], strict=True)] if words else []

    def encode(texts: list[str]) -> list[bytes]:
        if not kept["apart"]:
            return whole(texts)
        pieces.turn()
        words = [[t] if any(a in t for a in added) else PIECE.findall(t) for t in texts]
        out = [list(map(pieces.__getitem__, w)) for w in words]
        new = pieces.missed
        if new:
            plain, other = [], []
            for x in new:
                (plain if line(x) else other).append(x)
            new.update(zip(plain, lines(plain), strict=True))
            new.update(zip(other, whole(other), strict=True))
            for w, o in zip(words, out, strict=True):
                for i in [i for i, b in enumerate(o) if b is None]:
                    o[i] = new[w[i]]
            pieces.keep()
        return list(map(b"".join, out))

    return encode
