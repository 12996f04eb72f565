"""Tokens of whole texts with a bounded memo of the words seen.

A text is cut at each single space or line end that stands between two other characters: the splitting pattern of
byte-level vocabularies always starts a new match there (a line end is a match of its own), so the parts can be encoded
one by one, each with its leading space. Texts with other white space are cut by the pattern itself. Ids are little-endian unsigned 32-bit integers throughout."""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice

#: Marks that end many words; a run of them is one match of the pattern.
TAIL = "#*$%&|!,.;:?"
LATIN = "ɐ"  # below it, isalpha() and the pattern's letters are the same
MEMO = 500_000  # matches and words remembered at most; beyond it half of them go
LONGEST = 64  # characters of a remembered word at most


class Pieces:
    """encode(texts) from `ids_of`, which encodes matches of the pattern, and `split`, which lists a text's matches.

    Work goes by the different words of a set of texts: those the memo has not are cut into matches, and all new matches
    are encoded in one call, so `ids_of` can work on many at once."""

    def __init__(self, ids_of: Callable[[list[str]], list[bytes]], split: Callable[[str], list[str]], memo: int = MEMO):
        self.ids_of, self.split, self.memo = ids_of, split, memo
        self.words: dict[str, bytes] = {}  # ids of " " + word
        self.bare: dict[str, bytes] = {}  # ids of a match that is not a space and a word

    def forget(self) -> None:
        """Keep at most half of what may be remembered: the words met first, which are the common ones."""
        if len(self.words) > self.memo // 2:
            self.words = dict(islice(self.words.items(), self.memo // 2))
        self.bare.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) + len(self.bare) > self.memo:
            self.forget()
        words, bare = self.words, self.bare
        # a text's lines, each as its first word (which has no space before it) and the others
        lines = [[line.split(" ") for line in text.split("\n")] for text in texts]
        firsts = [[words_of.pop(0) for words_of in of] for of in lines]
        rests = [w for of in lines for w in of]
        cuts, opens, matches = {}, set(), set()
        for word in set().union(*rests).difference(words):
            if word.isalpha() and (word.isascii() or max(word) < LATIN):
                matches.add(" " + word)
            elif _open(word):
                opens.add(word)
            else:
                cuts[word] = self._pieces(word, " ")
        starts = {first: self._pieces(first, "") for first in set().union(*firsts) if not _open(first)}
        whole = {}  # texts with other white space than single spaces and line ends between other characters
        for i, of in enumerate(firsts):
            if not all(map(starts.__contains__, of)) or opens and any(not opens.isdisjoint(w) for w in lines[i]):
                whole[i] = self.split(texts[i])
        matches.add("\n")
        for found in (cuts, starts, whole):
            matches.update(*found.values())
        new = [m for m in matches if (m[1:] not in words if _spaced(m) else m not in bare)]
        for match, ids in zip(new, self.ids_of(new)):
            if _spaced(match):
                words[match[1:]] = ids
            else:
                bare[match] = ids
        known = lambda found: b"".join([words[m[1:]] if _spaced(m) else bare[m] for m in found])
        words.update({word: known(found) for word, found in cuts.items()})
        first_ids = {first: known(found) for first, found in starts.items()}
        ids_of, line_end = words.__getitem__, bare["\n"]
        made = [known(whole[i]) if i in whole else line_end.join([first_ids[f] + b"".join(map(ids_of, w)) for f, w in zip(of, lines[i])])
                for i, of in enumerate(firsts)]
        for key in [k for k in (*cuts, *(m.removeprefix(" ") for m in new)) if len(k) > LONGEST]:
            words.pop(key, None)
            bare.pop(key, None)
        return made

    def _pieces(self, word: str, before: str) -> list[str]:
        """The matches of a word that neither starts nor ends in white space, after a space or at a line's start."""
        core = word.rstrip(TAIL)
        if core.isalpha() and (core.isascii() or max(core) < LATIN):
            return [before + core] if len(core) == len(word) else [before + core, word[len(core):]]
        return self.split(before + word)


def _spaced(match: str) -> bool:
    return match[0] == " " and len(match) > 1 and not match[1].isspace()


def _open(chunk: str) -> bool:
    """True if a cut beside this chunk may not be a cut of the pattern."""
    return not chunk or chunk[0].isspace() or chunk[-1].isspace()
