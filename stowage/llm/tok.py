"""Exact encoding with public tokenizers, piece by piece with a bounded memo.

A text is cut only where no token can span the cut, so that the ids of the whole are the ids of its parts in order.
"""

from __future__ import annotations

import functools
import os
import re
import sys
from array import array
from collections.abc import Iterator

#: Texts that a worker encodes by both libraries before it relies on the faster one.
PROVED = 64
#: Most parts that a worker remembers in each of two generations, the longest part that it remembers, and the characters handled at once.
MEMO, LONGEST, SLAB = 400_000, 64, 1 << 20
#: Slots that tell which parts were met once, a power of two.
ONCE = 1 << 21
#: Marks that may follow a word, each a pre-token of its own.
MARKS = frozenset(".,;:!?")
#: The characters that stand for bytes in byte-level vocabularies: a printable one for itself, others from 256 on.
#: The byte-level vocabulary's pre-tokens.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
SPACE = chr(BYTE_CHARS[32])


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file; a name with a slash is taken as a path."""
    if "/" in name:
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def slabs(text: str) -> Iterator[str]:
    """text in parts of about SLAB characters, cut before a space that follows other than white space."""
    at = 0
    while len(text) - at > SLAB:
        end = at + SLAB
        while (end := text.find(" ", end)) > 0 and text[end - 1].isspace():
            end += 1
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    Words end at a space or a line feed. In a word-end vocabulary white space is dropped, so words stand alone; in a
    byte-level one a word takes the white space before it along, and a cut is safe if the character before it is not
    white space; texts for which that fails are encoded whole.
    """

    def __init__(self, name: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(tokenizer_path(name))
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.spaced = spaced
        self.ragged = re.compile(r"[ \n]*[^ \n]+|[ \n]+").findall
        #: What can stand between parts and is one id that nothing else gives.
        self.sep, self.sep_id = "", None
        for sep in [f" {c}" if spaced else f" {c} " for c in "§•★♥©→…"]:
            ids = self.lib.encode(sep, add_special_tokens=False).ids
            if len(ids) == 1 and self.sep_id is None:
                self.sep, self.sep_id = sep, ids[0]
        self.marks = {m: self.raw(m) for m in MARKS}
        #: The merges, if they can be had apart from the steps before them; a known sample must agree.
        self.model = self.lib.model if sys.byteorder == "little" else None
        for sample in ["stowage,", "Größe", "naïveté."] if self.model else []:
            if self.word(f" {sample}" if spaced else sample) != self.raw(f" {sample}" if spaced else sample):
                self.model = None
                break
        self.name = name
        self.ranks, self.unproved = self.ranked(), PROVED
        #: What is known, and what was known before the memo was last full.
        self.memo: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        #: By hash, whether a part was met since then.
        self.once = bytearray(ONCE)

    def raw(self, text: str) -> bytes:
        import numpy as np

        return np.asarray(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def parts(self, slab: str) -> list[str]:
        """The parts of a text; where white space is kept, a part's own first."""
        if not self.spaced:
            return slab.replace("\n", " ").split(" ")
        return self.ragged(slab)

    def apart(self, parts: list[str]) -> list[bytes]:
        """The ids of each of parts, by one call of the library over all of them with separators between."""
        import numpy as np

        text = self.sep.join(parts)
        if self.sep_id is not None and text.count(self.sep.strip(" ")) == len(parts) - 1:
            ids = np.asarray(self.lib.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.sep_id).tolist()
            if len(cuts) == len(parts) - 1:
                ids = ids.tobytes()
                return [ids[4 * a + 4 : 4 * b] for a, b in zip([-1, *cuts], [*cuts, len(ids) // 4], strict=True)]
        return [self.raw(p) for p in parts]

    def word(self, part: str) -> bytes | None:
        """The ids of a Latin-1 word, perhaps with a mark after it, straight from the model's merges; None for all else.

        Such a word is one pre-token, and so is the mark; the normalisers leave it but for its case.
        """
        core = part[1:] if self.spaced else part
        tail = b""
        if core[-1:] in MARKS:
            core, tail = core[:-1], self.marks[core[-1]]
        if not core.isalpha():
            return None
        if core.isascii():  # letters that stand for themselves
            text = f"{SPACE}{core}" if self.spaced else core.lower()
        else:
            try:
                core.encode("latin-1")
            except UnicodeEncodeError:
                return None
            text = (f" {core}" if self.spaced else core.lower()).encode().decode("latin-1").translate(BYTE_CHARS)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes() + tail

    def remember(self, made: dict[str, bytes]) -> None:
        """Add parts to the memo that are met again: most parts of junk never are, and would only fill it."""
        memo, once, old = self.memo, self.once, self.old
        for p, x in made.items():
            at = hash(p) & ONCE - 1
            if once[at] or p in old:
                if len(p) <= LONGEST:
                    memo[p] = x
            else:
                once[at] = 1

    def part_ids(self, parts: list[str]) -> bytes | None:
        """The ids of parts in order; None if they can't be encoded one by one."""
        memo = self.memo
        got = list(map(memo.get, parts))
        if None in got:
            holes = [k for k, x in enumerate(got) if x is None]
            new = dict.fromkeys([parts[k] for k in holes])
            lone = [p for p in new if p[-1].isspace() or p[0] not in " \n"] if self.spaced else []
            if any(p[-1].isspace() and p.strip(" \n") for p in lone):
                return None
            old, made, rest = self.old, {}, []
            made.update((p, self.raw(p)) for p in lone if p not in old)
            for p in new:
                if p not in made:
                    if (x := old.get(p)) is None and self.model and (p[0] == " " or not self.spaced):
                        x = self.word(p)
                    if x is None:
                        rest.append(p)
                    else:
                        made[p] = x
            if rest:
                made.update(zip(rest, self.apart(rest), strict=True))
            for k in holes:
                got[k] = made[parts[k]]
            if len(memo) + len(made) > MEMO:
                self.old, self.memo, self.once = memo, {"": b""}, bytearray(ONCE)
            self.remember(made)
        return b"".join(got)

    def ranked(self):
        """The vocabulary as merge ranks for the faster byte-level library, None where they can't be had or don't agree.

        Its patterns are the same, so ids are too; it is asked only about Latin-1 texts, whose letters, digits and white
        space no version of Unicode tells apart.
        """
        if not self.spaced:
            return None
        try:
            import tiktoken
        except ImportError:
            return None
        chars = {chr(c): b for b, c in BYTE_CHARS.items()} | {chr(b): b for b in _PRINTABLE}
        ranks = {bytes(map(chars.__getitem__, t)): n for t, n in self.lib.get_vocab(with_added_tokens=False).items() if t not in self.special}
        if sorted(ranks.values()) != list(range(len(ranks))) or any(bytes([b]) not in ranks for b in range(256)):
            return None
        made = tiktoken.Encoding(self.name, pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        every = " ".join(f"{chr(a)}x {chr(a)}{chr(a)}  {chr(a)} 1{chr(a)}'s" for a in range(256)) + "\n \n"
        return made if made.encode_ordinary(every) == self.lib.encode(every, add_special_tokens=False).ids else None

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" in text and any(s in text for s in self.special):
            return self.raw(text)
        if self.ranks:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.through(text)
            ids = self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            if self.unproved:  # the first texts of every worker are encoded both ways
                self.unproved -= 1
                if ids != (own := self.through(text)):
                    self.ranks = None
                    return own
            return ids
        return self.through(text)

    def through(self, text: str) -> bytes:
        """The ids of a text by the tokenizers library."""
        out = []
        for slab in slabs(text):
            ids = self.part_ids(self.parts(slab))
            if ids is None:
                return self.raw(text)
            out.append(ids)
        return b"".join(out)


@functools.cache
def encoder(name: str, spaced: bool) -> Encoder:
    """One encoder for each worker."""
    return Encoder(name, spaced)
