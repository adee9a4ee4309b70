"""Whole texts to token ids by way of a cache of pieces and words.

The pre-tokenizer pattern of byte-level vocabularies always breaks between a non-space character
and a following space or line feed, and the pieces between such breaks are tokenized
independently. So texts are cut there with str.split, pieces not seen before are cut into words
by the pattern, and only words not seen before reach the tokenizer.
"""

from __future__ import annotations

import re
from collections.abc import Callable

# Characters of the Unicode property White_Space.
WHITE = "\t-\r \x85\xa0  -     　"


def regular(text: str) -> bool:
    """Whether all white space is one space or one line feed between two other characters."""
    if "\0" in text or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n"):
        return False
    # The only printable white space is the space.
    return text.replace("\n", "").isprintable() or text.replace("\n", " ").split(" ") == text.split()


class TextEncoder:
    """encode_many(texts) -> for each text its ids as little-endian uint32 bytes.

    `encode_words` does the same for a list of words, `encode_text` for one text with any white space.
    Words are split off only where all characters are below `plain`, so that no two versions of
    Unicode can disagree about their classes; other pieces go to `encode_text`.

    In the cache a piece or word that starts with a space goes without it, a piece that starts with a line feed
    as it is, anything else behind a NUL; so one split of a text gives the keys of its pieces, each looked up once.
    Texts are taken `at_once` characters at a time, which bounds the pieces held. The cache is emptied when it has more than `entries`.
    """

    def __init__(self, encode_words: Callable[[list[str]], list[bytes]], encode_text: Callable[[str], bytes], pattern: re.Pattern, plain: str = "ɐ", entries: int = 1_500_000, longest: int = 100, at_once: int = 1 << 20) -> None:
        self._words_of, self._text, self._split, self._plain = encode_words, encode_text, pattern.findall, plain
        self._wide = re.compile(f"[{re.escape(plain)}-\U0010ffff]")
        self._marks = frozenset(m for m in ",.;:!?" if self._split(" a" + m) == [" a", m])  # words of their own behind letters
        self._most, self._longest, self._at_once = entries, longest, at_once
        self._seen: dict[str, bytes] = {}  # pieces and words

    def _learn(self, unknown: set[str]) -> dict[str, bytes]:
        """Ids of pieces not seen before, by their keys; long ones are returned and not kept."""
        once: dict[str, bytes] = {}
        if self._wide.search(" ".join(unknown)):
            once.update((k, self._text(_piece(k))) for k in unknown if not (k.isascii() or max(k) < self._plain))
        once.update((k, self._text(_piece(k))) for k in unknown if len(k) > self._longest and k not in once)
        unknown = unknown.difference(once)
        new = set(filter(str.isalpha, unknown))  # a space and letters: a word as it is
        ended: list[tuple[str, str, str]] = []  # such a word and a mark
        cut: list[tuple[str, list[str]]] = []
        for k in unknown.difference(new):
            if k[-1] in self._marks and k[:-1].isalpha():
                ended.append((k, k[:-1], "\0" + k[-1]))
            else:
                cut.append((k, [_key(w) for w in self._split(_piece(k))]))
        seen = self._seen
        new |= {w for e in ended for w in e[1:] if w not in seen}
        new |= {w for _, ws in cut for w in ws if w not in seen}
        keys = list(new)
        seen.update(zip(keys, self._words_of([w[1:] if w[0] == "\0" else " " + w for w in keys])))
        get = seen.__getitem__
        seen.update([(k, get(w) + get(m)) for k, w, m in ended])
        for k, ws in cut:
            seen[k] = b"".join(map(get, ws))
        return once

    def encode_many(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        group: list[str] = []
        size = 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size >= self._at_once:
                out += self._encode_group(group)
                group, size = [], 0
        return out + self._encode_group(group)

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        seen = self._seen
        if len(seen) > self._most:
            seen.clear()
        out: list[bytes] = [b""] * len(texts)
        cut: list[tuple[int, list[str]]] = []
        for i, t in enumerate(texts):
            if t and regular(t):
                cut.append((i, ("\0" + t).replace("\n", " \n").split(" ")))
            elif t:
                out[i] = self._text(t)
        unknown = set().union(*(keys for _, keys in cut)).difference(seen)
        once = self._learn(unknown) if unknown else {}
        seen.update(once)
        for i, keys in cut:
            out[i] = b"".join(map(seen.__getitem__, keys))
        for k in once:
            del seen[k]
        return out


def _piece(key: str) -> str:
    return key[1:] if key[0] == "\0" else key if key[0] == "\n" else " " + key


def _key(word: str) -> str:
    return word[1:] if word[0] == " " and len(word) > 1 else "\0" + word
