"""Token ids of whole texts from a tokenizer file of the ``tokenizers`` library, with pieces encoded once.

Texts repeat their words, and between certain neighbours a tokenizer never
merges. So a text is cut there, each different piece is encoded by the library
once per task and kept in a bounded cache, and the ids of a text are the joined
ids of its pieces. Texts for which a cut could matter go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces in a generation of a task's cache, and the longest piece kept.
CACHE_PIECES = 150_000
CACHE_PIECE_CHARS = 100
#: Texts cut together, and pieces whose ids are gathered together.
STEP_TEXTS = 3_000
GATHER_PIECES = 250_000


@lru_cache(maxsize=4)
def library(path: str):
    """The tokenizer of a file, without truncation or padding; one per worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def split_kind(path: str) -> str:
    """How texts of a tokenizer file may be cut: ``blank``, ``space`` or ``whole``.

    ``blank``: a Split step keeps only matches that hold no white space, so
    blanks and line ends separate. ``space``: the byte-level pattern starts a
    piece at a blank before a word. Everything else is encoded whole.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    tokens = [t["content"] for t in spec.get("added_tokens", [])]
    plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")) for t in spec.get("added_tokens", []))
    if not plain or any(re.search(r"\s", t) for t in tokens):
        return "whole"
    if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not normal:
        return "space"
    steps = before.get("pretokenizers", [])
    kept = [s.get("type") for s in normal.get("normalizers", [])]
    if (
        [s.get("type") for s in steps] == ["Split", "ByteLevel"] and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
        and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space")
        and re.fullmatch(r"('\w+\|)*\[\\p\{L\}\]\+\|\[\\p\{N\}\]\|\[\^\\s\\p\{L\}\\p\{N\}\]\+", steps[0]["pattern"].get("Regex", ""))
        and kept == ["NFC", "Replace", "Lowercase"]
    ):
        return "blank"
    return "whole"


#: Latin letters; all but the dotted capital I, whose lower case ends in a combining mark.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
_STOP = f"([0-9{_LATIN}])([.,])[ \n]"
_STOP_LINE = f"([0-9{_LATIN}])([.,])\n([{_LATIN}])"
_STOP_BLANK = f"([0-9{_LATIN}])([.,]) "
#: Stands before a piece that no blank leads; texts that hold it stay whole.
_BARE = "\x02"


@dataclass
class Cut:
    """Texts as numbers of different strings, which may be encoded apart: text i is ``codes[ends[i]:ends[i + 1]]``."""

    strings: list[str]
    codes: np.ndarray
    ends: np.ndarray
    whole: list[int]  # texts that must stay whole


def cut(texts: pa.StringArray, kind: str, specials: list[str]) -> Cut:
    """Cut texts without nulls at blanks (and line ends, for ``blank``); the numbering is done by Arrow.

    A full stop or comma between a Latin letter and white space, and a line end
    between it and a letter, are pre-tokens of their own in both kinds, so words
    are numbered without them. For ``space`` a blank stays before its piece:
    where another blank, white space or the end follows, or a special string
    stands, a cut could part what the tokenizer reads together, and the text
    stays whole.
    """
    apart = np.zeros(len(texts), dtype=bool)
    if kind == "blank":  # such a tokenizer lower-cases
        texts = pc.replace_substring_regex(pc.ascii_lower(texts), _STOP, r"\1 \2 ")
        texts = pc.replace_substring(texts, "\n", " ")
    else:
        apart = pc.match_substring(texts, _BARE).to_numpy(zero_copy_only=False)
        texts = pc.replace_substring_regex(texts, _STOP_LINE, f"\\1 {_BARE}\\2 {_BARE}\n {_BARE}\\3")
        texts = pc.replace_substring_regex(texts, _STOP_BLANK, rf"\1 {_BARE}\2 ")
    lists = pc.split_pattern(texts, " ")
    ends = lists.offsets.to_numpy()
    encoded = lists.flatten().dictionary_encode()
    codes, pieces = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary.to_pylist()
    strings, odd = pieces, np.zeros(len(pieces), dtype=bool)
    if kind == "space":
        odd = np.fromiter((not p or p[0].isspace() for p in pieces), dtype=bool, count=len(pieces))
        used, first = np.unique(codes[ends[:-1]], return_inverse=True)
        codes[ends[:-1]] = len(pieces) + first
        strings = [p[1:] if p[:1] == _BARE else " " + p for p in pieces] + [pieces[i] for i in used.tolist()]
        odd = np.concatenate((odd, np.zeros(len(used), dtype=bool)))
    joined = "\x00".join(pieces)
    for special in specials:
        if special in joined:
            odd |= np.fromiter((special in s for s in strings), dtype=bool, count=len(strings))
    if odd.any():
        apart[np.searchsorted(ends, np.flatnonzero(odd[codes]), side="right") - 1] = True
    whole = np.flatnonzero(apart).tolist()
    return Cut(strings, codes, ends, whole)


class Cache:
    """A bounded map in two generations: a full one becomes the old one, and what is used again moves on."""

    def __init__(self):
        self.young, self.old = {}, {}

    def resolve(self, strings: list[str], make: Callable[[list[str]], list]) -> list:
        """Values of different strings; missing ones are made together."""
        if len(self.young) > CACHE_PIECES:
            self.young, self.old = {}, self.young
        found = list(map(self.young.get, strings))
        lost = [i for i, v in enumerate(found) if v is None]
        missing = []
        for i in lost:
            found[i] = self.old.get(strings[i])
            if found[i] is None:
                missing.append(i)
        for i, value in zip(missing, make([strings[i] for i in missing]) if missing else ()):
            found[i] = value
        self.young.update((strings[i], found[i]) for i in lost if len(strings[i]) <= CACHE_PIECE_CHARS)
        return found


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit bytes, equal to the library's."""

    def __init__(self, path: str):
        self.tokenizer, self.kind = library(path), split_kind(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self.tokenizer.token_to_id(self.specials[0]) if self.specials else None
        self.kind = self.kind if self.specials else "whole"
        self.cache = Cache()

    def encode(self, texts: pa.StringArray | list[str | None]) -> Iterator[bytes]:
        """Ids of each text, one text after another; null and empty texts have none."""
        texts = pc.fill_null(pa.array(texts, type=pa.string()) if isinstance(texts, list) else texts, "")
        for start in range(0, len(texts), STEP_TEXTS):
            part = texts.slice(start, STEP_TEXTS)
            yield from self.whole(part.to_pylist()) if self.kind == "whole" else self._step(part)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def separate(self, pieces: list[str]) -> list[bytes]:
        """Ids of many short pieces, each encoded on its own, in few library calls; a special string ends each."""
        out: list[bytes] = []
        for start in range(0, len(pieces), 2000):
            words = [w for p in pieces[start:start + 2000] for w in (p, self.specials[0])]
            (e,) = self.tokenizer.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(e.ids, dtype="<u4")
            ends = (np.flatnonzero(ids == self.mark) * 4).tolist()
            ids = ids.tobytes()
            out += [ids[a:b] for a, b in zip([0, *[x + 4 for x in ends]], ends)]
        return out

    def _step(self, texts: pa.StringArray) -> Iterator[bytes]:
        found = cut(texts, self.kind, self.specials)
        odd = {i for i, s in enumerate(found.strings) if any(x in s for x in self.specials)} if found.whole else ()
        strings = [s if i not in odd else "" for i, s in enumerate(found.strings)] if odd else found.strings
        table = self.cache.resolve(strings, self.separate)
        sizes = np.fromiter(map(len, table), dtype=np.int64, count=len(table)) // 4
        first = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(table), dtype="<u4")
        rest = dict(zip(found.whole, self.whole([texts[i].as_py() for i in found.whole]))) if found.whole else {}
        at = 0
        while at < len(texts):
            # texts of about GATHER_PIECES pieces at a time
            stop = max(at + 1, int(np.searchsorted(found.ends, found.ends[at] + GATHER_PIECES, side="right")) - 1)
            codes = found.codes[found.ends[at]:found.ends[stop]]
            size = sizes[codes]
            ends = np.cumsum(size)
            ids = flat[np.repeat(first[codes] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
            bounds = np.concatenate(([0], ends))[found.ends[at:stop + 1] - found.ends[at]].tolist()
            for i in range(at, stop):
                yield rest[i] if i in rest else ids[bounds[i - at]:bounds[i - at + 1]].tobytes()
            at = stop


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of a file, kept with its cache from task to task of a worker process."""
    return Encoder(path)
