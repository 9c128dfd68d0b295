"""Byte pair encoding with word ends, from a public tokenizer file: merge tables, prefix counts, streaming encoder and decoder.

A text is cut at ASCII white space into chunks, a chunk into pieces by the file's own normaliser and pre-tokenizer.
Neither looks across white space, so a chunk's tokens depend on the chunk alone and are memoised.
"""

from __future__ import annotations

import codecs
import heapq
import json
import os
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain

from quartermill.llm._common import Memo

NEVER = 1 << 60
#: White space to str.split() that the tokenizer doesn't take for white space.
SEPARATORS = "\x1c\x1d\x1e\x1f"
#: The file's split pattern, for Latin-1 text in lower case and without white space.
LATIN_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
#: How the file normalises and cuts texts; others are refused.
LAYOUT = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    None,
    None,
)
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
WHITE = re.compile("[\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Merge tables of one tokenizer file (its JSON text)."""

    def __init__(self, spec: str, memo_entries: int = 300_000):
        from tokenizers import Tokenizer

        raw = json.loads(spec)
        model = raw["model"]
        if (raw["normalizer"], raw["pre_tokenizer"], raw["post_processor"], raw["decoder"]) != LAYOUT or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")):
            raise ValueError("the tokenizer file cuts texts in another way than this encoder")
        self.library = Tokenizer.from_str(spec)
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in raw["added_tokens"]}
        self.special_re = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.special_hint = os.path.commonprefix(list(self.special))
        self.surface = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.letters = byte_letters()
        self.rank: dict[int, int] = {}  # by left << 20 | right
        self.product: list[int] = []
        self.made: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for n, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.rank[left << 20 | right] = n
            self.product.append(whole)
            self.made[whole] = n
            self.halves[whole] = (left, right)
        self.longest = max((len(t) - len(self.end) * t.endswith(self.end) for t in self.vocab), default=1)
        self.lookahead = self._sufficient_lookahead()
        self._latin = {c: "".join(self.letters[b] for b in chr(c).encode()) for c in range(256)}
        self._continuing = {self.letters[b] for b in range(0x80, 0xC0)}
        self._sound: dict[int, bool] = {}
        self._bytes: dict = {}
        self._trie, self._plain, self._final = self._endings()
        short = lambda key: len(key) <= 200
        self._stay = Memo(memo_entries, self._compute_stay)
        self.piece_ids = Memo(memo_entries, self._compute_piece_ids, short)
        self.chunk_ids = Memo(memo_entries, self._compute_chunk_ids, short)
        self.piece_total = Memo(memo_entries, self._compute_piece_total, short)
        self.chunk_total = Memo(memo_entries, lambda chunk: sum(map(self.piece_total.__getitem__, self.pieces(chunk))), short)

    # ---- cutting -------------------------------------------------------------------------------------------------

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special strings; True marks one."""
        if not self.special_re or self.special_hint not in text:
            return [(text, False)]
        return [(x, x in self.special) for x in self.special_re.split(text) if x]

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The runs between white space."""
        if any(c in text for c in SEPARATORS):
            return [x for x in WHITE.split(text) if x]
        return text.split()

    def normal(self, chunk: str) -> str:
        """The chunk as the tokenizer's normaliser leaves it; Latin-1 is in normal form already."""
        return chunk.lower() if max(chunk) < "\u0100" else self.library.normalizer.normalize_str(chunk)

    def pieces(self, chunk: str) -> list[str]:
        """The chunk's pieces, in byte letters."""
        if chunk.isascii():
            own = LATIN_PIECE.findall(chunk.lower())
            return own if chunk.isprintable() else [x.translate(self._latin) for x in own]
        if max(chunk) < "\u0100":
            return [x.translate(self._latin) for x in LATIN_PIECE.findall(chunk.lower())]
        return [x for x, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))]

    # ---- merge list ----------------------------------------------------------------------------------------------

    def _sufficient_lookahead(self) -> int:
        """Symbols to the right of a boundary that can decide what is merged across it.

        A merge (x, y) needs y whole. Only merges of a lower rank across y's right end can prevent that, and they start
        at a token of y's right spine; so the reach of each merge follows from those of lower rank.
        """
        reach: dict[int, int] = {}
        length = {i: len(t) - len(self.end) * (t.endswith(self.end) and len(t) > len(self.end)) for t, i in self.vocab.items()}
        most = 1
        for whole in self.product:
            x, y = self.halves[whole]
            further, u = 0, y
            while True:
                further = max(further, reach.get(u, 0))
                if u not in self.halves:
                    break
                u = self.halves[u][1]
            own = length[y] + further
            reach[x] = max(reach.get(x, 0), own)
            most = max(most, own)
        return most

    def merge(self, ids: list[int]) -> list[int]:
        """All merges, the lowest rank first and the leftmost of a rank first."""
        rank, product = self.rank.get, self.product
        if len(ids) <= 48:
            ranks = [rank(a << 20 | b, NEVER) for a, b in zip(ids, ids[1:])]
            while ranks and (best := min(ranks)) < NEVER:
                i = ranks.index(best)
                ids[i : i + 2] = [product[best]]
                del ranks[i]
                if i:
                    ranks[i - 1] = rank(ids[i - 1] << 20 | ids[i], NEVER)
                if i < len(ranks):
                    ranks[i] = rank(ids[i] << 20 | ids[i + 1], NEVER)
            return ids
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = product[r], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (s := rank(ids[p] << 20 | ids[q])) is not None:
                    heapq.heappush(queue, (s, p, ids[p], ids[q]))
        return [x for x in ids if x >= 0]

    def apart(self, a: int, b: int, whole: bool = False) -> bool:
        """Whether tokens a and b, side by side, stay two tokens. whole: not counting their own merge.

        The tokens along a's right edge and b's left edge stand side by side for a while each; a merge of two of them that
        comes before either is used otherwise would join a and b.
        """
        u, u_used = a, NEVER
        while True:
            v, v_used = b, NEVER
            while True:
                r = self.rank.get(u << 20 | v)
                if r is not None and r < u_used and r <= v_used and self.made.get(v, -1) < u_used and self.made.get(u, -1) < v_used and not (whole and u == a and v == b):
                    return False
                if v not in self.halves:
                    break
                v_used, v = self.made[v], self.halves[v][0]
            if u not in self.halves:
                return True
            u_used, u = self.made[u], self.halves[u][1]

    def sound(self, token: int) -> bool:
        """Whether the token's own letters merge to it."""
        known = self._sound.get(token)
        if known is None:
            if token not in self.halves:
                known = True
            else:
                a, b = self.halves[token]
                known = self.sound(a) and self.sound(b) and self.apart(a, b, whole=True)
            self._sound[token] = known
        return known

    # ---- prefix dynamic programming ------------------------------------------------------------------------------

    def _endings(self) -> tuple[dict[int, int], dict[int, int], dict[int, int]]:
        """A trie of the sound tokens read backwards: steps by node << 10 | letter, and the token at a node without and with word end."""
        trie, plain, final = {}, {}, {}
        for name, token in self.vocab.items():
            if self.sound(token):
                ends = name.endswith(self.end) and len(name) > len(self.end)
                node = 0
                for c in reversed(name[: -len(self.end)] if ends else name):
                    node = trie.setdefault(node << 10 | ord(c), len(trie) + 1)
                (final if ends else plain)[node] = token
        return trie, plain, final

    def _last_tokens(self, codes: list[int], upto: int) -> tuple[list[int], list[int]]:
        """For each prefix of the piece, no word end after it: its last token and its number of tokens.

        The last token of a prefix is the one sound token, ending there, that stays apart from the last token of what is before it.
        """
        trie, plain, stay = self._trie.get, self._plain.get, self._stay
        last, count = [-1] * (upto + 1), [0] * (upto + 1)
        for i in range(1, upto + 1):
            node, at = 0, i
            while at and (node := trie(node << 10 | codes[at - 1])) is not None:
                at -= 1
                t = plain(node)
                if t is not None and (not at or stay[last[at] << 20 | t]):
                    last[i], count[i] = t, count[at] + 1
                    break
        return last, count

    def _compute_stay(self, pair: int) -> bool:
        return self.apart(pair >> 20, pair & 0xFFFFF)

    def _ended(self, codes: list[int], j: int, last: list[int], count: list[int]) -> int:
        """Tokens of the piece's first j letters with the word end after them."""
        node, at = 0, j
        while at and (node := self._trie.get(node << 10 | codes[at - 1])) is not None:
            at -= 1
            t = self._final.get(node)
            if t is not None and (not at or self._stay[last[at] << 20 | t]):
                return count[at] + 1
        raise ValueError("the vocabulary lacks a byte")

    def _compute_piece_total(self, piece: str) -> int:
        codes = list(map(ord, piece))
        return self._ended(codes, len(codes), *self._last_tokens(codes, len(codes) - 1))

    def chunk_prefixes(self, chunk: str) -> list[int]:
        """Tokens of each prefix of the normalised chunk, by code point: entry p is for the first p+1."""
        out: list[int] = []
        base = 0
        for letters in self.pieces(chunk):
            if letters in CONTRACTIONS:
                mark = self.piece_total["'"]
                out += [base + mark] + [base + mark + self.piece_total[letters[1:k]] for k in range(2, len(letters))]
                out.append(base + self.piece_total[letters])
            else:
                codes = list(map(ord, letters))
                last, count = self._last_tokens(codes, len(codes) - 1)
                for j in range(1, len(codes) + 1):
                    if j == len(codes) or letters[j] not in self._continuing:
                        out.append(base + self._ended(codes, j, last, count))
            base = out[-1]
        return out

    # ---- decoding ------------------------------------------------------------------------------------------------

    def bytes_of(self, spelled: bool):
        """A function from a token to its bytes."""
        if spelled not in self._bytes:
            code, names = {c: b for b, c in enumerate(self.letters)}, set(self.special.values())
            table = {}
            for token, name in self.surface.items():
                ends = name.endswith(self.end)
                if spelled or token in names:
                    table[token] = name.encode() + (b"" if spelled else b" ")
                else:
                    table[token] = bytes(code[c] for c in (name[: -len(self.end)] if ends else name)) + b" " * ends
            self._bytes[spelled] = table.__getitem__
        return self._bytes[spelled]

    # ---- encoding ------------------------------------------------------------------------------------------------

    def _compute_piece_ids(self, piece: str) -> tuple[int, ...]:
        stream = StreamEncoder(self)
        out: list[int] = []
        for at in range(0, len(piece), 512):
            out += stream.feed(piece[at : at + 512])
        return tuple(out + stream.finish())

    def _compute_chunk_ids(self, chunk: str) -> tuple[int, ...]:
        own = [self.piece_ids[x] for x in self.pieces(chunk)]
        return own[0] if len(own) == 1 else tuple(i for x in own for i in x)

    def encoded(self, text: str, size: int = 1 << 16) -> Iterator[list[int]]:
        """The ids, as many at a time as about `size` letters give; cut at white space, where no token crosses."""
        for part, special in self.parts(text):
            if special:
                yield [self.special[part]]
                continue
            at = 0
            while at < len(part):
                cut = WHITE.search(part, at + size) if at + size < len(part) else None
                to = cut.start() if cut else len(part)
                yield list(chain.from_iterable(map(self.chunk_ids.__getitem__, self.chunks(part[at:to]))))
                at = to

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encoded(text)))


class StreamEncoder:
    """Encodes one piece as its letters come, and gives each token as soon as no later letter can change it.

    The buffer begins at a boundary between tokens. A token that ends `lookahead` letters or more before the buffer's end
    is stable, so the buffer never holds more than the lookahead, a token and what came last.
    """

    def __init__(self, tables: WordBpe):
        self.tables = tables
        self.buffer = ""

    def feed(self, letters: str) -> list[int]:
        self.buffer += letters
        tables = self.tables
        if len(self.buffer) <= 2 * tables.lookahead + tables.longest:
            return []
        ids = tables.merge([tables.vocab[c] for c in self.buffer])
        out, at, safe = [], 0, len(self.buffer) - tables.lookahead
        for token in ids:
            to = at + len(tables.surface[token])
            if to > safe:
                break
            out.append(token)
            at = to
        self.buffer = self.buffer[at:]
        return out

    def finish(self) -> list[int]:
        """The rest, the last letter ending the word."""
        tables, letters = self.tables, self.buffer
        self.buffer = ""
        if not letters:
            return []
        return tables.merge([*(tables.vocab[c] for c in letters[:-1]), tables.vocab[letters[-1] + tables.end]])


class StreamDecoder:
    """Tokens to text as they come: bytes of a character that a token leaves open wait for the next token.

    spelled: the library's way for a file without a decoder, tokens as the vocabulary spells them with a space between;
    else the text itself, a space for each word end and after a special token.
    """

    def __init__(self, tables: WordBpe, spelled: bool = False):
        self.spelled, self.first = spelled, True
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.bytes_of = tables.bytes_of(spelled)

    def feed(self, tokens: list[int]) -> str:
        """What these tokens settle. The machine's state is the open bytes, three at most."""
        own = (b" " if self.spelled else b"").join(map(self.bytes_of, tokens))
        if self.spelled and tokens and not self.first:
            own = b" " + own
        self.first = self.first and not tokens
        return self.machine.decode(own)

    def finish(self) -> str:
        return self.machine.decode(b"", final=True)


class PrefixTable:
    """Token counts at every prefix of a text (normalised, white space as one space, by code points), kept by chunk.

    Chunk ends hold cumulative counts; inside a chunk the dynamic programme's row answers. Nothing is encoded again.
    """

    def __init__(self, tables: WordBpe, text: str):
        self.tables, self.text = tables, text
        self.units = [(x, special) for part, special in tables.parts(text) for x in ([part] if special else tables.chunks(part))]
        self.plain = not text or max(text) < "\u0100"
        self.totals = list(accumulate((1 if special else tables.chunk_total[x] for x, special in self.units), initial=0))

    @property
    def total(self) -> int:
        return self.totals[-1]

    def lengths(self) -> list[int]:
        """Of the chunks; Latin-1 keeps its lengths."""
        return [len(x) if special or self.plain else len(self.tables.normal(x)) for x, special in self.units]

    def fits(self, budget: int) -> int:
        """Code points of the longest prefix, chunks counted without the white space between, of at most budget tokens."""
        n = bisect_right(self.totals, budget) - 1
        chars = sum(self.lengths()[:n]) if n < len(self.units) else sum(self.lengths())
        if n < len(self.units) and not self.units[n][1]:
            left = budget - self.totals[n]
            row = self.tables.chunk_prefixes(self.units[n][0])
            chars += max((p + 1 for p, c in enumerate(row) if c <= left), default=0)
        return chars

    def cut(self, budget: int) -> int:
        """Code points of a prefix of the text itself that has at most budget tokens, and more with the next code point.

        All of the text if it fits. In a chunk whose normal form has another length, the place is sought from the normal form's.
        """
        n = bisect_right(self.totals, budget) - 1
        if n >= len(self.units):
            return len(self.text)
        at = self._starts()[n]
        unit, special = self.units[n]
        if special:
            return at
        left, total = budget - self.totals[n], self.tables.chunk_total
        q = min(len(unit), max((p + 1 for p, c in enumerate(self.tables.chunk_prefixes(unit)) if c <= left), default=0))
        if not self.plain:
            while q and total[unit[:q]] > left:
                q -= 1
            while q < len(unit) and total[unit[: q + 1]] <= left:
                q += 1
        return at + q

    def _starts(self) -> list[int]:
        """Where each unit begins in the text."""
        out, at = [], 0
        for unit, _ in self.units:
            at = self.text.index(unit, at)
            out.append(at)
            at += len(unit)
        return out

    def at(self, chars: int) -> int:
        """Tokens of the prefix of so many code points, chunks counted without the white space between."""
        for n, size in enumerate(self.lengths()):
            if chars < size:
                if not chars:
                    return self.totals[n]
                return self.totals[n] + (self.tables.chunk_prefixes(self.units[n][0])[chars - 1])
            chars -= size
        return self.totals[-1]
