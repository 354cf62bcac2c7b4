"""Token ids of whole texts by the tokenizers library, through a word cache."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .worker import take_over

#: Ends every document.
END_ID = 1
#: Words longer than this are encoded each time, so the cache's bytes are bounded.
LONGEST_CACHED = 64
#: Words in each of the cache's two generations.
CACHE_WORDS = 350_000

_READY: dict[str, "WordEncoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def read_definition(path: str) -> str:
    """The tokenizer file's JSON; it is small and travels to the workers with the task."""
    return Path(path).read_text(encoding="utf-8")


#: What never joins a full stop or comma behind it: letters and digits of ASCII, and the bytes of U+00C0 to U+017F.
_APART = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 192)) + b"\xc3\xc4\xc5"
#: The two of these characters that aren't letters.
_NO_LETTERS = (b"\xc3\x97", b"\xc3\xb7")
#: In what is left of a text without them, a mark right before a full stop or comma.
_JOINED_MARK = re.compile(rb"\S[.,]")
#: Characters whose lower case or composed form isn't one letter that stands for itself: all but ASCII and U+00C0 to U+017F, and U+0130.
_UNSAFE = re.compile(rb"[\xc2\xc6-\xff]|\xc4\xb0")


class WordEncoder:
    """Encodes texts word by word (words: runs between ASCII white space).

    For tokenizers whose pre-tokenizer never joins characters across white
    space this equals encoding the whole text; ``tests/llm`` checks that. Each
    distinct word goes to the library once per generation of the cache. If the
    normalizer lower-cases, texts that hold nothing but ASCII and the letters
    U+00C0 to U+017F without U+0130 are folded before the look-up: A-Z to lower
    case, and a full stop or comma between a letter and white space apart,
    which the pre-tokenizer does as well. In such a text nothing composes and
    every letter's lower case is one letter; all others go to the library as
    they are. Words of letters alone are encoded many in one call and told
    apart by the tokens' end-of-word mark.
    """

    def __init__(self, definition: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.cache_words = cache_words
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        model = json.loads(definition)
        suffix = model["model"].get("end_of_word_suffix")
        kinds = [n.get("type") for n in (model.get("normalizer") or {}).get("normalizers", [])]
        self.fold = bool(suffix) and "Lowercase" in kinds
        self.ends = np.zeros(max(model["model"]["vocab"].values(), default=0) + 4096, bool)
        if self.fold:
            self.ends[[i for t, i in model["model"]["vocab"].items() if t.endswith(suffix)]] = True

    def _each(self, words: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.asarray(e.ids, "<u4").tobytes() for e in encoded]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone: many in one text, cut after each end-of-word token."""
        parts = [words[at : at + 128] for at in range(0, len(words), 128)]
        encoded = self.tokenizer.encode_batch_fast(list(map(" ".join, parts)), add_special_tokens=False)
        out = []
        for part, e in zip(parts, encoded):
            ids = np.asarray(e.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):  # a letter's normal form has a mark in it: that word is several
                out += self._each(part)
                continue
            raw, cuts = ids.tobytes(), (cuts * 4).tolist()
            out += [raw[a:b] for a, b in zip([0, *cuts], cuts)]
        return out

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        old = self.old
        found = {w: old[w] for w in filter(old.__contains__, words)}
        new = [w for w in words if w not in found]
        letters = list(filter(str.isalpha, new)) if self.fold else []
        for at in range(0, len(letters), 4096):
            part = letters[at : at + 4096]
            found.update(zip(part, self._letters(part)))
        rest = [w for w in new if w not in found]
        for at in range(0, len(rest), 4096):
            found.update(zip(rest[at : at + 4096], self._each(rest[at : at + 4096])))
        return found

    def _folded(self, text: str | None) -> bytes:
        if not text:
            return b""
        raw = text.encode("utf-8", "replace")
        if not self.fold or b"<" in raw or _UNSAFE.search(raw):  # "<" may begin a special token, which is told by its case
            return raw
        raw = raw.lower() + b" "
        if not _JOINED_MARK.search(raw.translate(None, _APART)) and not any(c in raw for c in _NO_LETTERS):
            for mark in (b". ", b", ", b".\n", b",\n"):
                raw = raw.replace(mark, b" " + mark)
        return raw

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids (uint32) of each text; a null text has none. The end id isn't added.

        Distinct words of the texts are looked up once, and put back in order
        by Arrow's kernels, so that what goes word by word isn't Python.
        """
        if len(self.young) > self.cache_words:
            self.young, self.old = {}, self.young
        raw = pa.array(list(map(self._folded, texts)), pa.large_binary())
        split = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(raw), raw.buffers()))
        coded = split.values.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.young.get, words))
        if None in found:
            new = self._learn([w for w, ids in zip(words, found) if ids is None])
            self.young.update((w, ids) for w, ids in new.items() if len(w) <= LONGEST_CACHED)
            found = [new[w] if ids is None else ids for w, ids in zip(words, found)]
        ends = np.cumsum([0, *map(len, found)], dtype=np.int64) // 4
        by_word = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<u4")))
        placed = by_word.take(coded.indices)
        ids, at = placed.values.to_numpy(), placed.offsets.to_numpy()[split.offsets.to_numpy()]
        return [ids[a:b] for a, b in zip(at, at[1:])]


def by_size(texts: list[str | None], most_chars: int = 2 << 20) -> Iterator[slice]:
    """Ranges of texts of some million characters together; one longer text stands alone."""
    start = held = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if held and held + n > most_chars:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(texts):
        yield slice(start, len(texts))


def encoder(definition: str) -> WordEncoder:
    """The worker's encoder of this definition; workers are reused, so its cache is too."""
    take_over("tokens", _READY.clear)
    if definition not in _READY:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _READY.clear()
        _READY[definition] = WordEncoder(definition)
    return _READY[definition]
