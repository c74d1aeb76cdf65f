"""Token ids of whole texts by the tokenizers library, with the ids of frequent words remembered."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np

from millrace.llm.common import REMEMBERED

#: The encoder remembers so many words (about 70 bytes each); when they are full, it forgets them and starts anew.
MOST_WORDS = 400_000
#: Words of up to 8 bytes for each of so many lanes are looked up all at once.
LANES = 3
#: Odd constants that mix lanes to a place in the table; words are told apart by their bytes.
ODDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype="<u8")
#: The first bytes, 0 to 8, of a lane.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype="<u8")
#: Characters for which lower case, composition and white space are the same in Python and in the library.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xff]*")
#: Two marks at a word's end, which the library doesn't separate.
RUN = re.compile(r"[!-/:-@\[-`{-~\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7][.,] ")
#: Texts are encoded in groups of about so many characters.
GROUP = 1 << 18
#: Unknown words in a line that the library is asked for.
LINE = 200
#: Fixed value: the split pattern of the tokenizers whose words are remembered. It never matches across white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def parts_of(definition: str, names: tuple[str, ...]) -> dict:
    """Members of a JSON object by name; others are read only if the first place that a name is followed by a colon holds a number or text."""
    out = {}
    for name in names:
        if found := re.search(rf'"{name}"\s*:\s*', definition):
            out[name] = json.JSONDecoder().raw_decode(definition, found.end())[0]
    if any(not isinstance(x, (dict, list, type(None))) for x in out.values()):
        whole = json.loads(definition)
        return {name: whole.get(name) for name in names}
    return out


class Words:
    """Ids of remembered words: a table with open addressing, in which all words of a text are found at once, by their bytes."""

    def __init__(self, most: int):
        self.most, self.bits = most, max(8, (3 * most - 1).bit_length())
        self.forget()

    def forget(self) -> None:
        self.n, self.long = 0, {}  # words are numbered from 1; long ones are in a dictionary
        self.table = np.zeros(1 << self.bits, dtype="<u4")  # number of a word; 0: free
        self.lanes = [np.zeros(1, dtype="<u8") for _ in range(LANES)]  # bytes of a word by number
        self.at, self.ids = np.zeros(2, dtype="<i8"), np.zeros(0, dtype="<u4")  # place of its ids by number; the next one's place is their end

    def _place(self, keys: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(keys[0]), dtype="<u8")
        for k, odd in zip(keys, ODDS, strict=True):
            h = (h ^ (h >> np.uint64(32)) ^ k) * odd
        return (h >> np.uint64(64 - self.bits)).astype("<i8")

    def find(self, keys: list[np.ndarray]) -> np.ndarray:
        """Numbers of words, 0 for others."""
        out, left, place = np.zeros(len(keys[0]), dtype="<i8"), np.arange(len(keys[0])), self._place(keys)
        while len(left):
            w = self.table[place]
            same = w > 0
            for lane, k in zip(self.lanes, keys, strict=True):
                same &= lane[w] == k[left]
            out[left[same]] = w[same]
            on = np.flatnonzero((w > 0) & ~same)
            left, place = left[on], (place[on] + 1) & (len(self.table) - 1)
        return out

    def lay(self, ids: np.ndarray, counts: np.ndarray) -> None:
        """Ids of words with the next numbers; the following call overwrites them, unless they are kept."""
        n, used, end = self.n + len(counts) + 2, int(self.at[self.n + 1]), int(self.at[self.n + 1]) + len(ids)
        if n > len(self.at):
            self.at = np.concatenate([self.at, np.zeros(n, dtype="<i8")])
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(end, dtype="<u4")])
        self.ids[used:end] = ids
        self.at[self.n + 2 : n] = used + np.cumsum(counts)

    def keep(self, keys: list[np.ndarray], long: list[bytes | None]) -> bool:
        """Remember the words that were laid last, unless there are too many; `long` has words that lanes don't hold."""
        first, last = self.n + 1, self.n + len(long)
        if last > self.most:
            return False
        if last >= len(self.lanes[0]):
            self.lanes = [np.concatenate([lane, np.zeros(last + 1, dtype="<u8")]) for lane in self.lanes]
        for lane, k in zip(self.lanes, keys, strict=True):
            lane[first : last + 1] = k
        self.long.update((b, first + j) for j, b in enumerate(long) if b is not None)
        w = np.array([first + j for j, b in enumerate(long) if b is None], dtype="<i8")
        place = self._place([k[w - first] for k in keys])
        while len(w):
            free = self.table[place] == 0
            self.table[place[free]] = w[free]
            on = self.table[place] != w
            w, place = w[on], (place[on] + 1) & (len(self.table) - 1)
        self.n = last
        return True

    def ids_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words by number, one after the other, and how many there are up to the end of each."""
        at = self.at[words]
        n = self.at[words + 1] - at
        ends = np.cumsum(n)
        return self.ids[np.repeat(at - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)], ends


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to the library's without special tokens.

    Where the tokenizer's file says that text is composed, blanks are merged, letters are lowered and SPLIT cuts what is
    encoded independently, a word's ids are asked for once and remembered while there is room; texts with characters outside PLAIN
    or with the text of an added token go to the library whole, as does everything under other kinds of tokenizer.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_str(definition)
        # The vocabulary is skipped: as Python objects it would take a worker more memory than all else.
        kind, spec = self.library.model.__class__.__name__, parts_of(definition, ("added_tokens", "normalizer", "pre_tokenizer"))
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        steps = [(n.get("type"), n.get("pattern"), n.get("content")) for n in norm.get("normalizers", [])]
        cut, *rest = pre.get("pretokenizers") or [{}]
        self.remembers = (
            kind == "BPE"
            and steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
            and (cut.get("type"), cut.get("pattern"), cut.get("behavior"), cut.get("invert")) == ("Split", {"Regex": SPLIT}, "Removed", True)
            and [(r.get("type"), r.get("add_prefix_space"), r.get("use_regex")) for r in rest] == [("ByteLevel", False, False)]
        )
        # Words of letters alone need neither normalizer nor split: blanks cut them, and the same model encodes their bytes.
        self.plain = Tokenizer(self.library.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words = Words(MOST_WORDS)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _asked(self, words: list[str], plain: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of words and their numbers, asked for in lines of many. `plain`: all are of letters alone."""
        lines = [words[i : i + LINE] for i in range(0, len(words), LINE)]
        ids, counts = [], []
        for line, e in zip(lines, (self.plain if plain else self.library).encode_batch([" ".join(x) for x in lines], add_special_tokens=False) if lines else [], strict=True):
            ids.append(np.array(e.ids, dtype="<u4"))
            if plain:
                counts.append(np.bincount(np.array(e.word_ids, dtype="<i8"), minlength=len(line)))
            else:
                starts = np.cumsum([0] + [len(w) + 1 for w in line])
                counts.append(np.diff(np.searchsorted(np.array([a for a, _ in e.offsets]), starts)))
        return ids, counts

    def _words(self, lows: list[str]) -> Iterator[bytes]:
        """Ids of texts of lower-case words, each followed by a blank."""
        parts = [t.encode() for t in lows]
        raw = b"".join(parts)
        buffer = np.frombuffer(raw + bytes(8 * LANES), dtype="u1")
        blanks = np.flatnonzero(buffer == 32)
        starts = np.concatenate([np.zeros(1, dtype="<i8"), blanks[:-1] + 1])
        some = blanks > starts
        starts, ends = starts[some], blanks[some]
        sizes, eights = ends - starts, np.lib.stride_tricks.as_strided(buffer[:8].view("<u8"), (len(buffer) - 7,), (1,))
        keys = [eights[starts] & FIRST[np.minimum(sizes, 8)]]
        for lane in range(1, LANES):
            more = np.flatnonzero(sizes > 8 * lane)
            keys.append(np.zeros(len(starts), dtype="<u8"))
            keys[-1][more] = eights[starts[more] + 8 * lane] & FIRST[np.minimum(sizes[more] - 8 * lane, 8)]
        known = self.words
        found = known.find(keys)
        for i in np.flatnonzero(sizes > 8 * LANES).tolist():
            found[i] = known.long.get(raw[starts[i] : ends[i]], 0)
        holes, kept = np.flatnonzero(found == 0), True
        if len(holes):
            new: dict[bytes, int] = {}
            which = [new.setdefault(raw[a:b], len(new)) for a, b in zip(starts[holes].tolist(), ends[holes].tolist(), strict=True)]
            asked = [b.decode() for b in new]
            letters = np.fromiter(map(str.isalpha, asked), dtype=bool, count=len(asked))
            order = np.argsort(~letters, kind="stable")
            got = [self._asked([asked[j] for j in np.flatnonzero(letters == plain).tolist()], plain) for plain in (True, False)]
            known.lay(np.concatenate([x for ids, _ in got for x in ids]), np.concatenate([x for _, counts in got for x in counts]))
            rank = np.empty(len(order), dtype="<i8")
            rank[order] = np.arange(len(order))
            which = rank[which]
            found[holes] = known.n + 1 + which
            example = np.empty(len(order), dtype="<i8")
            example[which] = holes
            long = [raw[a:b] if b - a > 8 * LANES else None for a, b in zip(starts[example].tolist(), ends[example].tolist(), strict=True)]
            kept = known.keep([k[example] for k in keys], long)
        ids, upto = known.ids_of(found)
        if not kept:
            known.forget()
        upto = np.concatenate([np.zeros(1, dtype="<i8"), upto])
        borders = upto[np.searchsorted(starts, np.cumsum([0] + [len(p) for p in parts]))].tolist()
        return (ids[a:b].tobytes() for a, b in zip(borders, borders[1:], strict=False))

    def _group(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        worded, lows, other = [], [], []
        for i, t in enumerate(texts):
            low = t.lower() if self.remembers and PLAIN.fullmatch(t) else None
            if low is None or any(a in t or a in low for a in self.added):
                other.append(i)
                continue
            low = low.replace("\n", " ").replace("\t", " ").replace("\r", " ") + " "
            if not RUN.search(low):  # a mark after a letter or digit is encoded by itself
                low = low.replace(". ", " . ").replace(", ", " , ")
            worded.append(i)
            lows.append(low)
        for i, b in zip(worded, self._words(lows) if lows else [], strict=True):
            out[i] = b
        for i, b in zip(other, self._whole([texts[i] for i in other]) if other else [], strict=True):
            out[i] = b
        return out

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Of each text in turn; null counts as empty."""
        group, size = [], 0
        for t in texts:
            group.append(t or "")
            size += len(group[-1])
            if size >= GROUP:
                yield from self._group(group)
                group, size = [], 0
        if group:
            yield from self._group(group)


_encoders: dict[int, Encoder] = {}
REMEMBERED.append(_encoders)


def encoder(definition: str) -> Encoder:
    """The worker process's encoder for a tokenizer file's text."""
    key = hash(definition)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition)
    return _encoders[key]


def definition_of(path: str) -> str:
    """A tokenizer file's text, read by the driver and sent to tasks; executors need no copy of the file."""
    with open(path, encoding="utf-8") as f:
        return f.read()
