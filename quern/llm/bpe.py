"""BPE encoding as a streaming transducer with bounded lookahead, and incremental decoding.

Text is fed in pieces; nothing but an unfinished tail is kept. Within a word
the merges run over a window: a token boundary is final once the window
reaches `lookahead` symbols past it, so tokens before it are emitted and the
window moves on. Memory stays constant however long a word or a text is.
Short words, which a window would hold whole, are merged many at a time, each
distinct one of some texts once.

Sufficient lookahead. A merge rule (u, v) at some place depends on text to its
right only if an earlier rule took a suffix of v as its own left part there.
That suffix is on the right spine of v's derivation (v, its right part, and so
on), and the earlier rule reaches |its v| symbols further, where the argument
repeats with still earlier rules. So, in rule order,
    reach(u, v) = max over earlier rules (u', v') with u' on the right spine
                  of v of |v'| + reach(u', v')
and a boundary is decided by max over rules of |v| + reach(u, v) symbols.

Defined results: null text counts as empty and has no tokens.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain, islice, repeat
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quern.llm.common import resident, small_batches

#: Characters that `Encoder.feed` gathers before it looks for a place to cut, and words a worker remembers.
PIECE, CACHE = 1 << 15, 1 << 18
#: Characters of the longest word that is remembered, and ids of a longer one that are handed on at a time.
LONG, SLICE = 64, 1 << 12
#: Characters of the longest text that is split together with others, and of all that are.
SHORT, SLAB = 1 << 20, 1 << 22
#: Symbols that a word's window takes in at a time, besides the lookahead.
STEP = 256


def byte_characters() -> list[str]:
    """For each byte the printable character that stands for it in the vocabulary: itself, or the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0x100
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class Merges:
    """The merge list of a tokenizer file: ranks, ids, and the lookahead that suffices."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        #: What the file says beside the vocabulary and the merges.
        self.file = {k: whole[k] for k in ("normalizer", "pre_tokenizer", "decoder")}
        model = whole["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {p: i for i, p in reversed(list(enumerate(pairs)))}
        self.tokens = {i: t for t, i in self.ids.items()} | {t["id"]: t["content"] for t in whole["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.lookahead = sufficient_lookahead(pairs, self.suffix)


def sufficient_lookahead(pairs: list[tuple[str, str]], suffix: str = "") -> int:
    """Symbols right of a token boundary that decide it (see the module's text)."""
    right_part: dict[str, str] = {}
    furthest: dict[str, int] = {}
    most = 0

    def length(token: str) -> int:
        return len(token) - len(suffix) if suffix and token.endswith(suffix) and len(token) > len(suffix) else len(token)

    for u, v in pairs:
        reach, spine = 0, v
        while spine is not None:
            reach = max(reach, furthest.get(spine, 0))
            spine = right_part.get(spine)
        beyond = length(v) + reach
        furthest[u] = max(furthest.get(u, 0), beyond)
        right_part.setdefault(u + v, v)
        most = max(most, beyond)
    return most


#: Above all ranks; with eight bits more it is an int32.
NONE = 1 << 22


def merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Apply the rules to a list of symbols in place, lowest rank first, leftmost first."""
    rank = ranks.get
    waiting = list(map(rank, zip(symbols, symbols[1:]), repeat(NONE)))
    while waiting:
        lowest = min(waiting)
        if lowest == NONE:
            break
        at = waiting.index(lowest)
        symbols[at] += symbols.pop(at + 1)
        del waiting[at]
        if at:
            waiting[at - 1] = rank((symbols[at - 1], symbols[at]), NONE)
        if at < len(waiting):
            waiting[at] = rank((symbols[at], symbols[at + 1]), NONE)
    return symbols


def transduce(symbols: Iterable[str], merges: Merges, step: int = STEP) -> Iterator[str]:
    """Tokens of a word's symbols, each as soon as it is stable; holds lookahead + step symbols and an unfinished token."""
    window: list[str] = []
    source = iter(symbols)
    look, ended = merges.lookahead, False
    fill = look + step
    while not ended:
        while len(window) < fill:
            try:
                window.append(next(source))
            except StopIteration:
                ended = True
                break
        tokens = merge(list(window), merges.ranks)
        if ended:
            yield from tokens
            return
        stable, at = len(window) - look, 0
        for token in tokens:
            size = len(token)
            if at + size > stable:
                break
            yield token
            at += size
        window = window[at:]
        fill = max(fill, len(window) + step) if at == 0 else look + step


class Together:
    """Merges many short words at a time, each lowest rank first, leftmost first: a place for each symbol of the longest word, and one merge a word in each."""

    #: Symbols of the longest word there may be.
    MOST = 256

    def __init__(self, merges: Merges) -> None:
        ids, characters = merges.ids, byte_characters()
        self.first = np.array([ids[c] for c in characters], np.int32)
        self.last = np.array([ids[c + merges.suffix] for c in characters], np.int32)
        # Rules by pair in an open hash table, four slots or more a rule; a rule's number is its rank.
        self.shift = np.uint64(64 - max(2, (4 * len(merges.ranks)).bit_length()))
        self.pairs = np.full(1 << (64 - int(self.shift)), -1, np.int64)
        self.ranks = np.full(len(self.pairs), NONE, np.int32)
        self.made = np.zeros(max(merges.ranks.values(), default=0) + 1, np.int32)
        pairs = np.array([ids[u] << 32 | ids[v] for u, v in merges.ranks], np.int64)
        for pair, slot, ((u, v), rank) in zip(pairs.tolist(), self._slots(pairs).tolist(), merges.ranks.items()):
            while self.pairs[slot] != -1:
                slot = (slot + 1) % len(self.pairs)
            self.pairs[slot], self.ranks[slot], self.made[rank] = pair, rank, ids[u + v]

    def _slots(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of pairs of ids: the rank of their rule, NONE without one."""
        shape, pairs = left.shape, (left.astype(np.int64) << 32 | right).ravel()
        slots = self._slots(pairs)
        seen = self.pairs[slots]
        out = self.ranks[slots]
        astray = np.flatnonzero(seen != pairs)
        out[astray] = NONE
        astray = astray[seen[astray] != -1]
        slots = slots[astray]
        while len(astray):
            slots = slots + 1 & len(self.pairs) - 1
            seen = self.pairs[slots]
            met = seen == pairs[astray]
            out[astray[met]] = self.ranks[slots[met]]
            on = ~met & (seen != -1)
            astray, slots = astray[on], slots[on]
        return out.reshape(shape)

    def __call__(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words raw[begin:end] of UTF-8, none empty nor over MOST: all ids, and for each word where its own begin and how many they are."""
        where, count, pool, filled = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64), [], 0
        sizes = end - begin
        order = np.argsort(sizes, kind="stable")
        bounds = np.searchsorted(sizes[order], np.arange(self.MOST + 2))
        words, tokens, ranks = order[:0], np.empty((0, 0), np.int32), np.empty((0, 0), np.int32)
        for width in range(int(sizes.max(initial=0)), 0, -1):
            # Those of one more symbol that have had a merge, and the words of this size.
            fresh = order[bounds[width] : bounds[width + 1]]
            if len(fresh):
                spelled = raw[begin[fresh] + np.arange(width)[:, None]]
                new = self.first[spelled]
                new[-1] = self.last[spelled[-1]]
                new_ranks = self._rank(new[:-1], new[1:])
                if len(words):
                    fresh, new, new_ranks = np.concatenate([words, fresh]), np.concatenate([tokens, new], 1), np.concatenate([ranks, new_ranks], 1)
                words, tokens, ranks = fresh, new, new_ranks
            if not len(words):
                continue
            low = (ranks << 8 | np.arange(width - 1, dtype=np.int32)[:, None]).min(0, initial=NONE << 8)
            going = low < NONE << 8
            done = np.flatnonzero(~going)
            if len(done):
                pool.append(tokens[:, done].T.ravel())
                where[words[done]] = filled + np.arange(len(done)) * width
                count[words[done]] = width
                filled += len(done) * width
                going = np.flatnonzero(going)
                words, tokens, ranks, low = words[going], tokens[:, going], ranks[:, going], low[going]
            if not len(words):
                continue
            at, row = low & 255, np.arange(len(words))
            before = np.arange(width - 1)[:, None] < at
            tokens = np.where(before, tokens[:-1], tokens[1:])
            tokens[at, row] = self.made[low >> 8]
            ranks = np.where(before[:-1], ranks[:-1], ranks[1:])
            for some, k in ((row[at > 0], at[at > 0] - 1), (row[at < width - 2], at[at < width - 2])):
                ranks[k, some] = self._rank(tokens[k, some], tokens[k + 1, some])
        return np.concatenate(pool) if pool else np.empty(0, np.int32), where, count


def latin(text: str) -> bool:
    """Whether all characters are below U+0100, where Unicode versions agree."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Remembered(dict):
    """Results by word, found when first asked for; forgets all once there are CACHE of them, and keeps none for a word over LONG."""

    def __init__(self, find) -> None:
        super().__init__()
        self.find = find

    def __missing__(self, word):
        if isinstance(word, str) and len(word) > LONG:
            return self.find(word)
        if len(self) >= CACHE:
            self.clear()
        self[word] = found = self.find(word)
        return found


#: The byte-level pre-tokenizer's own pattern is a fixed value.
OWN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: The pattern of a word vocabulary, also a fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Kinds of characters: letters, numbers, others, white space, and what stands between two texts.
LETTER, NUMBER, OTHER, WHITE, BETWEEN = range(5)


def kinds() -> np.ndarray:
    """The kind of each of the first 256 characters."""
    classes = [(LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")]
    return np.array([next((k for k, c in classes if regex.match(c, chr(i))), OTHER) for i in range(256)], np.uint8)


def starts(data: np.ndarray, ends: np.ndarray, pattern: str, table: np.ndarray) -> np.ndarray:
    """Where the words begin that OWN or WORDS finds in texts of one byte a character, each closed by a byte at `ends`, which is a word too.

    With WORDS the white space before a word is part of it, and no text may end in white space.
    """
    kind = table[data]
    kind[ends] = BETWEEN
    new = np.ones(len(data), bool)
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[ends] = True
    new[ends[:-1] + 1] = True
    after = np.flatnonzero((kind[:-1] == WHITE) & (kind[1:] < WHITE)) + 1
    if pattern == OWN:
        # The last white character before a word stands alone, or is part of the word if it is a space.
        new[after - 1] = True
        new[after] = data[after - 1] != 0x20
    else:
        new |= kind == NUMBER
    # A lone apostrophe that begins a word takes these letters along; the closing byte is none of them.
    lone = np.flatnonzero(data[:-1] == 0x27)
    lone = lone[new[lone] & (kind[lone + 1] == LETTER)]
    for tail in (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d") if len(lone) else ():
        at = lone[data[lone + 1] == tail[0]]
        if len(tail) == 2:
            at = at[data[at + 2] == tail[1]]
        new[at + 1] = False
        new[at + 1 + len(tail)] = True
    if pattern == WORDS:
        new[after] = False
    return np.flatnonzero(new)


def narrow(pattern: str = OWN) -> re.Pattern:
    """A pattern for texts of the first 256 characters alone, on the standard engine, which is faster there; classes as the other engine sees them."""
    classes = {kind: "".join(f"\\x{c:02x}" for c in range(256) if regex.match(kind, chr(c))) for kind in (r"\p{L}", r"\p{N}", r"\s", r"\S")}
    kind = re.compile("|".join(map(re.escape, classes)))
    inside = lambda m: classes[m.group()]
    # A set with its kinds inside, or a kind that stands alone.
    return re.compile(re.sub(rf"\[[^]]*\]|{kind.pattern}", lambda m: kind.sub(inside, m.group()) if m.group()[0] == "[" else f"[{inside(m)}]", pattern))


class Encoder:
    """Feeds of text in, token ids out."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        parts = merges.file["pre_tokenizer"].get("pretokenizers") or [merges.file["pre_tokenizer"]]
        split = next((p for p in parts if p["type"] == "Split"), None)
        pattern = split["pattern"]["Regex"] if split else OWN
        self.pattern = regex.compile(pattern)
        #: The pattern if it is one of the two that `shared` and `narrow` know.
        self.plain = pattern if pattern in (OWN, WORDS) else None
        #: For pieces of the first 256 characters, which normal forms and lower case keep so.
        self.narrow = narrow(pattern) if self.plain else self.pattern
        self.together = Together(merges)
        self.kinds = kinds()
        self.white = "".join(chr(i) for i in np.flatnonzero(self.kinds == WHITE))
        normalizer = merges.file["normalizer"] or {"type": "Sequence", "normalizers": []}
        self.normalizers = {n["type"] for n in normalizer.get("normalizers", [normalizer])}
        self.special = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None
        #: What all special tokens begin with.
        self.sign = commonprefix(list(merges.special))
        self.characters = byte_characters()
        self.known = Remembered(self._word)
        #: Characters whose classes and normal forms the library sees as Python does; Unicode versions differ in the newest.
        self.agreed = set(map(chr, range(256)))
        self.library = None

    def _symbols(self, word: str) -> Iterator[str]:
        raw = word.encode()
        for at, b in enumerate(raw, 1):
            yield self.characters[b] + self.merges.suffix if at == len(raw) else self.characters[b]

    def stream(self, word: str) -> Iterator[int]:
        """The ids of a word, each as soon as its token is stable."""
        return map(self.merges.ids.__getitem__, transduce(self._symbols(word), self.merges))

    def _word(self, word: str) -> tuple[int, ...]:
        if len(word) > LONG:
            return tuple(self.stream(word))
        # So short that a window would hold all of it.
        symbols = list(map(self.characters.__getitem__, word.encode()))
        if symbols:
            symbols[-1] += self.merges.suffix
        return tuple(map(self.merges.ids.__getitem__, merge(symbols, self.merges.ranks)))

    def normalize(self, text: str) -> str:
        if latin(text):
            return text.lower() if "Lowercase" in self.normalizers else text
        if "NFC" in self.normalizers:
            text = unicodedata.normalize("NFC", text)
        if "Lowercase" in self.normalizers:
            # Python has a special case for a final sigma, the library lowers each character alone.
            text = text.replace("Σ", "σ").lower()
        return text

    def cuts(self, text: str) -> Iterator[str]:
        """Pieces of at least PIECE characters that end between words: before a space or line end that follows a letter.

        A special token holds no white space, so none is cut.
        """
        at, size = 0, len(text)
        while size - at > PIECE:
            found = CUT.search(text, at + PIECE)
            if found is None:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def words(self, text: str) -> Iterator[str | int]:
        """Words of a text, and the ids of special tokens in it."""
        return chain.from_iterable(self.lists(text))

    def lists(self, text: str) -> Iterator[list]:
        for piece in self.cuts(text):
            at = 0
            for m in self.special.finditer(piece) if self.special and self.sign in piece else ():
                yield self._words(piece[at : m.start()])
                yield [self.merges.special[m.group()]]
                at = m.end()
            yield self._words(piece[at:] if at else piece)

    def shared(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray | None]]]:
        """For some texts at a time, in order: ids, where those of each distinct word begin, how many they are, and the words of each text.

        None stands for a text that `words` has to split: a long one, one with
        special tokens, with words over LONG or with characters beyond the
        first 256.
        """
        some, size = [], 0
        for text in texts:
            if some and size + min(len(text), SHORT) > SLAB:
                yield self._shared(some)
                some, size = [], 0
            some.append(text)
            size += min(len(text), SHORT)
        if some:
            yield self._shared(some)

    def _shared(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray | None]]:
        places: list[np.ndarray | None] = [None] * len(texts)
        special = self.sign if self.special else None
        fit = [i for i, t in enumerate(texts) if self.plain and len(t) <= SHORT and latin(t) and (special is None or special not in t)]
        bodies = [self.normalize(texts[i]) for i in fit]
        if self.plain == WORDS:
            bodies = [b.rstrip(self.white) for b in bodies]
        if not fit:
            return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), places
        raw = ("\0".join(bodies) + "\0").encode("latin-1")
        ends = np.cumsum([len(b) + 1 for b in bodies]) - 1
        begin = starts(np.frombuffer(raw, np.uint8), ends, self.plain, self.kinds)
        bounds = np.append(begin, len(raw)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        # The distinct words, in UTF-8.
        _, offsets, body = coded.dictionary.buffers()
        offsets = np.frombuffer(offsets, np.int32)[: len(coded.dictionary) + 1].astype(np.int64)
        data = np.frombuffer(body, np.uint8)[: offsets[-1]]
        first, last = offsets[:-1].copy(), offsets[1:]
        long = last - first > LONG
        if self.plain == WORDS:
            led = np.flatnonzero(~long & (self.kinds[data[first]] == WHITE))
            while len(led):
                first[led] += 1
                led = led[self.kinds[data[first[led]]] == WHITE]
        wider = np.concatenate([[0], np.cumsum(data >= 0x80)])
        utf8 = np.frombuffer(data.tobytes().decode("latin-1").encode(), np.uint8)
        last = np.where(long, first, last)
        short = np.flatnonzero(~long)
        ids, at, n = self.together(utf8, (first + wider[first])[short], (last + wider[last])[short])
        where, count = np.zeros((2, len(first)), np.int64)
        where[short], count[short] = at, n
        codes, start = coded.indices.to_numpy(), 0
        for i, end in zip(fit, np.searchsorted(begin, ends).tolist()):
            found = codes[start:end]
            if len(short) == len(first) or not long[found].any():
                places[i] = found
            start = end + 1
        return ids, where, count, places

    def _words(self, piece: str) -> list[str]:
        if latin(piece):
            return self.narrow.findall(self.normalize(piece))
        if new := set(piece) - self.agreed:
            self.agreed |= {c for c in new if self.pattern.findall(self.normalize(f"a{c}a1{c}")) == self._library_words(f"a{c}a1{c}")}
            if not new <= self.agreed:
                return self._library_words(piece)
        return self.pattern.findall(self.normalize(piece))

    def _library_words(self, piece: str) -> list[str]:
        """As the library itself normalises and splits."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.merges.path)
            self.bytes = {c: b for b, c in enumerate(self.characters)}
        body = self.library.normalizer.normalize_str(piece) if self.library.normalizer else piece
        return [bytes([self.bytes[c] for c in w]).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(body)]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for word in self.words(text):
            if isinstance(word, int):
                out.append(word)
            else:
                out.extend(self.known[word])
        return out


#: A letter, one space or line end, a letter: no pattern, normal form or special token spans the place before the white space.
CUT = regex.compile(r"(?<=\p{L})[ \n](?=\p{L})")


class Decoder:
    """Ids in, text out, as soon as its bytes are complete.

    With a byte-level decoder each token's characters stand for bytes, which
    run through an incremental UTF-8 machine; a file without decoder joins the
    tokens with one space.
    """

    def __init__(self, merges: Merges) -> None:
        self.tokens = merges.tokens
        self.special = set(merges.special.values())
        decoder = merges.file["decoder"]
        self.bytes = {c: b for b, c in enumerate(byte_characters())} if decoder and decoder["type"] == "ByteLevel" else None
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.first = True

    def feed(self, ids: Iterable[int]) -> str:
        if self.bytes is None:
            body = " ".join([self.tokens[i] for i in ids])
            if not body:
                return ""
            lead, self.first = "" if self.first else " ", False
            return lead + body
        return "".join(self._one(i) for i in ids)

    def _one(self, token_id: int) -> str:
        token = self.tokens[token_id]
        try:
            raw = bytes(self.bytes[c] for c in token)
        except KeyError:
            raw = token.encode()
        return self.machine.decode(raw)

    def finish(self) -> str:
        return "" if self.bytes is None else self.machine.decode(b"", True)


class Digester:
    """Encodes and decodes whole texts into digests; remembers common words, holds one piece of a text at a time."""

    def __init__(self, merges: Merges) -> None:
        self.merges, self.encoder = merges, Encoder(merges)
        self.bytes = merges.file["decoder"] is not None
        self.numbers = list(map(str, range(max(merges.tokens) + 1)))
        self.spelled = Remembered(self._spelled)

    def _spelled(self, word: str | int) -> tuple[str, str | tuple[int, ...]] | None:
        """What `_line` says of a word; None where it is so long that its ids come in slices."""
        if isinstance(word, int):
            return self._line((word,))
        return self._line(self.encoder._word(word)) if len(word) <= LONG else None

    def _line(self, ids: tuple[int, ...]) -> tuple[str, str | tuple[int, ...]]:
        """The ids with spaces between, and what is decoded: tokens with spaces between, or the ids of a byte-level file."""
        return " ".join([self.numbers[i] for i in ids]), ids if self.bytes else " ".join([self.merges.tokens[i] for i in ids])

    def _runs(self, text: str) -> Iterator[list[tuple[str, str | tuple[int, ...]]]]:
        """The lines of a text's words, some at a time."""
        for words in self.encoder.lists(text):
            for at in range(0, len(words), 1 << 14):
                some = words[at : at + (1 << 14)]
                found = list(map(self.spelled.__getitem__, some))
                if all(found):
                    yield found
                    continue
                for word, line in zip(some, found):
                    if line is not None:
                        yield [line]
                        continue
                    ids = self.encoder.stream(word)
                    while part := tuple(islice(ids, SLICE)):
                        yield [self._line(part)]

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of tokens, SHA-256 of the ids, SHA-256 of the decoded text)."""
        ids_hash, text_hash, decoder, n = hashlib.sha256(), hashlib.sha256(), Decoder(self.merges), 0
        for found in self._runs(text):
            lead = " " if n else ""
            ids = " ".join([f[0] for f in found])
            ids_hash.update((lead + ids).encode())
            if self.bytes:
                text_hash.update("".join(decoder.feed(f[1]) for f in found).encode())
            else:
                text_hash.update((lead + " ".join([f[1] for f in found])).encode())
            n += ids.count(" ") + 1
        text_hash.update(decoder.finish().encode())
        return n, ids_hash.hexdigest(), text_hash.hexdigest()


    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """The digest of each text."""
        if self.bytes:
            yield from map(self.digest, texts)
            return
        at = 0
        for ids, where, count, places in self.encoder.shared(texts):
            ids = ids.tolist()
            lines = [self._line(ids[k : k + n]) for k, n in zip(where.tolist(), count.tolist())]
            numbers, tokens = [line[0] for line in lines], [line[1] for line in lines]
            for text, place in zip(texts[at : at + len(places)], places):
                if place is None:
                    yield self.digest(text)
                    continue
                place = place.tolist()
                body, plain = " ".join(map(numbers.__getitem__, place)), " ".join(map(tokens.__getitem__, place))
                yield body.count(" ") + 1 if place else 0, hashlib.sha256(body.encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest()
            at += len(places)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256. `path` must be readable on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = resident(("bpe", path), lambda: Digester(Merges(path))).digests
        for batch in batches:
            out = list(digests([text or "" for text in batch.column(1).to_pylist()]))
            columns = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    schema = docs.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
