"""Token counts by prefix dynamic programming over a word-end BPE vocabulary.

For every prefix of a text the table holds the exact number of tokens that the
tokenizers library gives for that prefix, so "how many tokens" and "where must the text
be cut to fit a budget" are look-ups; nothing is encoded again.

White space separates units, and a prefix differs from the whole text in its last
unit only, so a text's table is two levels deep: a total for each unit, and within a unit
the counts of its prefixes, closed from the unit's programme when they are asked for.  Inside a unit the
library's pieces (letter runs, single digits, other runs, contractions) are a dynamic
programme over their symbols: a sequence of BPE tokens is the encoding of its text exactly
when each neighbouring pair is, so the last token of a prefix is the one vocabulary entry
that ends there and can stand after the last token of what precedes it, and its count is one
more than that prefix's.  A piece's last symbol carries the word-end mark, so a
second look-up, among the entries with the mark, closes each prefix.

Units of plain Latin letters are split by a regular expression; all others follow the
library's own normaliser and character classes (a run of combining characters is
normalised anew at each of them).  Special tokens inside a text are one token each, as
the library's default has it; a prefix that ends inside one holds ordinary characters.

A null text counts as empty: no bytes, no tokens, cut at 0.  Bytes that are no UTF-8 are
read as U+FFFD.  Equal texts have equal rows; an empty table gives an empty one.  Other columns
stay; one that is named like a new column is replaced.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, per_process

MODEL_PATH = "/opt/tokenizers/word_bpe_49k.json"
MAX_MODEL_BYTES = 64 << 20
LIMIT = 2048
# Kept in a worker process: bytes of units and pieces with their counts, and token pairs.
KEPT_BYTES = 240 << 20
KEPT_PAIRS = 1_000_000
LONGEST_KEPT = 128
ENTRY_BYTES = 180
BLOCK_CHARS = 1 << 20

# --- fixed values (of the tokenizer's file) -----------------------------------
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]
SPLIT_RX = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPACE = r"\x09-\x0D\x20\x85\xA0  -     　"
# -----------------------------------------------------------------------------
SPACES, LETTER, NUMBER, OTHER, CLOSED = range(5)
NONE = -1
# Below U+0250 no character combines with another, and only U+0130 changes its length in lower case.
LATIN_END, DOTTED_I = "ɐ", "İ"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    out, spare = [], 256
    for b in range(256):
        printable = 33 <= b <= 126 or 161 <= b <= 172 or b >= 174
        out.append(chr(b if printable else spare))
        spare += not printable
    return out


def _reach(tokens: dict[str, int]) -> dict[str, int]:
    out: dict[str, int] = {}
    for t in tokens:
        if len(t) > 2:
            out[t[-3:]] = max(len(t), out.get(t[-3:], 0))
    return out


class Merges:
    """Which tokens stand next to each other in an encoding, by the vocabulary's merge ranks."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self.plain = {t: i for t, i in vocab.items() if not t.endswith(suffix)}
        self.ends = {t[:-len(suffix)]: i for t, i in vocab.items() if t.endswith(suffix) and len(t) > len(suffix)}
        self.longest = max(map(len, (*self.plain, *self.ends)))
        # How far back a token can begin, by the three symbols that it ends in.
        self.reach, self.reach_end = _reach(self.plain), _reach(self.ends)
        self.rank: dict[tuple[int, int], int] = {}
        # The merge that makes a token: its rank, left and right part.
        self.made: dict[int, tuple[int, int, int]] = {}
        for k, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = k
            if whole in self.made or self.made.get(a, (-1,))[0] >= k or self.made.get(b, (-1,))[0] >= k:
                raise ValueError("a token with two merges, or with a part that is merged after it")
            self.made[whole] = k, a, b
        self.known: dict[int, bool] = {}

    def follows(self, before: int, token: int) -> bool:
        """``token`` can stand after ``before`` (NONE: at the start).

        The merges of both are undone, the latest first; no pair of parts that
        meet at the border may merge before its left or its right part is used up.  Of
        equal ranks the leftmost merges first.
        """
        if before == NONE:
            return True
        key = before << 32 | token
        ok = self.known.get(key)
        if ok is None:
            if len(self.known) >= KEPT_PAIRS:
                self.known.clear()
            ok = self.known[key] = self._apart(before, token)
        return ok

    def _apart(self, a: int, b: int) -> bool:
        made, never = self.made, len(self.rank)
        used_a = used_b = never
        while True:
            rank = self.rank.get((a, b), never)
            if rank < used_a and rank <= used_b and rank != never:
                return False
            rank_a, rank_b = made[a][0] if a in made else -1, made[b][0] if b in made else -1
            if rank_a < 0 and rank_b < 0:
                return True
            if rank_a > rank_b:
                used_a, _, a = made[a]
            else:
                used_b, b, _ = made[b]


class Piece:
    """The programme over one piece: last token and token count of each of its open prefixes."""

    def __init__(self, merges: Merges):
        self.merges, self.symbols, self.last, self.count = merges, [], [NONE], [0]

    def _ending(self, window: str, low: int, table: dict[str, int]) -> tuple[int, int]:
        end, last, follows = len(window), self.last, self.merges.follows
        for j in range(end):
            token = table.get(window[j:end])
            if token is not None and follows(last[low + j], token):
                return token, self.count[low + j] + 1
        raise ValueError(f"the vocabulary cannot encode {window!r}")

    def push(self, char: str) -> int:
        """Symbols of one more character; the count of what was pushed, as a whole piece."""
        window, low = "", 0
        for s in char:
            self.symbols.append(s)
            low = max(0, len(self.symbols) - self.merges.longest)
            window = "".join(self.symbols[low:])
            token, n = self._ending(window, low, self.merges.plain)
            self.last.append(token)
            self.count.append(n)
        return self._ending(window, low, self.merges.ends)[1]

    def cut(self, n: int) -> None:
        del self.symbols[n:], self.last[n + 1:], self.count[n + 1:]


class Reader:
    """Follows normalised characters one by one; ``tokens`` counts all that was pushed.

    ``mark`` and ``back`` return to an earlier place, as long as only places after it were
    pushed meanwhile.
    """

    def __init__(self, counter: Counter):
        self.counter = counter
        self.done, self.kind, self.piece, self.open = 0, SPACES, None, 0
        self.quote, self.before_quote = "", 0

    @property
    def tokens(self) -> int:
        return self.done + self.open

    def mark(self) -> tuple:
        return (self.done, self.kind, self.piece, len(self.piece.symbols) if self.piece else 0, self.open, self.quote, self.before_quote)

    def back(self, mark: tuple) -> None:
        self.done, self.kind, self.piece, n, self.open, self.quote, self.before_quote = mark
        if self.piece:
            self.piece.cut(n)

    def push(self, char: str) -> None:
        kind, counter = self.counter.kind(char), self.counter
        quote = self.quote + char if self.quote else ""
        if quote in CONTRACTIONS:
            self.done, self.open = self.before_quote, counter.piece_total(quote)
            self.kind, self.piece, self.quote = CLOSED, None, ""
            return
        if kind != self.kind or kind not in (LETTER, OTHER):
            self.done += self.open
            self.open, self.kind, self.piece = 0, kind, Piece(counter.merges) if kind != SPACES else None
            if char == "'":
                quote, self.before_quote = char, self.done
        self.quote = quote if any(c.startswith(quote) for c in CONTRACTIONS) else ""
        if self.piece:
            self.open = self.piece.push(counter.symbols(char))


class Kept:
    """Bounded memory of what is often asked: the older half goes when the newer one is full."""

    def __init__(self, most_bytes: int):
        self.most, self.size, self.new, self.old = most_bytes // 2, 0, {}, {}

    def get(self, key: str) -> object:
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key: str, value: object, more: int = 0) -> None:
        if len(key) > LONGEST_KEPT:
            return
        self.size += len(key) + more + ENTRY_BYTES
        if self.size > self.most:
            self.old, self.new, self.size = self.new, {}, len(key) + more + ENTRY_BYTES
        self.new[key] = value


class Counter:
    """Prefix counts of units and texts for one tokenizer file."""

    def __init__(self, blob: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(blob)
        model, normalizer, split = spec["model"], spec["normalizer"] or {}, spec["pre_tokenizer"].get("pretokenizers", [])
        if (model["type"] != "BPE" or not model["end_of_word_suffix"] or model["unk_token"] or model["ignore_merges"]
                or [n["type"] for n in normalizer.get("normalizers", [])] != NORMALIZERS
                or [s["type"] for s in split] != ["Split", "ByteLevel"] or split[0]["pattern"] != {"Regex": SPLIT_RX}):
            raise ValueError("not a word-end BPE tokenizer of the expected kind")
        self.library = Tokenizer.from_str(blob.decode())
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_rx = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.unit_rx, self.space_rx = regex.compile(f"[^{SPACE}]+"), regex.compile(f"[{SPACE}]")
        self.piece_rx = regex.compile(rf"\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.bytes = byte_symbols()
        self.kinds: dict[str, int] = {}
        self.spelt: dict[str, str] = {}
        # Totals of units and pieces, and the counts of all prefixes of those that were asked for them.
        self.units, self.pieces, self.prefixes = Kept(KEPT_BYTES // 2), Kept(KEPT_BYTES // 4), Kept(KEPT_BYTES // 4)

    def symbols(self, char: str) -> str:
        found = self.spelt.get(char)
        if found is None:
            found = self.spelt[char] = "".join([self.bytes[b] for b in char.encode("utf-8", "replace")])
        return found

    def kind(self, char: str) -> int:
        """The library's class of a normalised character."""
        found = self.kinds.get(char)
        if found is None:
            def pieces(s: str) -> int:
                return len(self.library.pre_tokenizer.pre_tokenize_str(s))
            found = self.kinds[char] = (SPACES if pieces(char) == 0 else LETTER if pieces("a" + char) == 1
                                        else OTHER if pieces("!" + char) == 1 else NUMBER)
        return found

    def piece(self, chars: str) -> tuple:
        """Counts of each prefix of one piece, each as a piece of its own."""
        found = self.prefixes.get(chars)
        if found is None:
            parts = [self.symbols(c) for c in chars]
            found = tuple(self._programme("".join(parts), [len(p) for p in parts]))
            self.prefixes.put(chars, found, 8 * len(found))
        return found

    def piece_total(self, chars: str) -> int:
        found = self.pieces.get(chars)
        if found is None:
            symbols = chars if chars.isascii() and chars.isprintable() else "".join([self.symbols(c) for c in chars])
            found = self._programme(symbols, [len(symbols)])[0]
            self.pieces.put(chars, found)
        return found

    def _programme(self, symbols: str, sizes: list[int]) -> list[int]:
        """``Piece`` in one go: the counts after each group of ``sizes`` symbols, closed there."""
        merges = self.merges
        plain, ends, known, apart = merges.plain.get, merges.ends.get, merges.known.get, merges.follows
        reach, reach_end = merges.reach.get, merges.reach_end.get
        last, count, closed, i = [NONE], [0], [], 0
        for size in sizes:
            for i in range(i + 1, i + size + 1):
                low = i - reach(symbols[i - 3:i], 2) if i > 2 else 0
                for j in range(low if low > 0 else 0, i):
                    token = plain(symbols[j:i])
                    if token is not None:
                        fits = known(last[j] << 32 | token) if j else True
                        if fits or fits is None and apart(last[j], token):
                            last.append(token)
                            count.append(count[j] + 1)
                            break
            low = i - reach_end(symbols[i - 3:i], 2) if i > 2 else 0
            for j in range(low if low > 0 else 0, i):
                token = ends(symbols[j:i])
                if token is not None and (not j or apart(last[j], token)):
                    closed.append(count[j] + 1)
                    break
        if len(last) != len(symbols) + 1 or len(closed) != len(sizes):
            raise ValueError(f"the vocabulary cannot encode {symbols[:80]!r}")
        return closed

    def _is_plain(self, chars: str) -> bool:
        return max(chars) < LATIN_END and "'" not in chars and DOTTED_I not in chars and not self.special_rx.search(chars)

    def unit(self, chars: str) -> tuple:
        """Counts of each prefix of one unit (a run without white space)."""
        if not self._is_plain(chars):
            return self._any_unit(chars)
        out, done = [], 0
        for p in self.piece_rx.findall(chars.lower()):
            out += [done + n for n in self.piece(p)]
            done = out[-1]
        return tuple(out)

    def unit_total(self, chars: str) -> int:
        found = self.units.get(chars)
        if found is None:
            if self._is_plain(chars):
                found = sum([self.piece_total(p) for p in self.piece_rx.findall(chars.lower())])
            else:
                found = self._any_unit(chars)[-1]
            self.units.put(chars, found)
        return found

    def _any_unit(self, chars: str) -> tuple:
        out: list[int] = []
        reader, at = Reader(self), 0
        for hit in self.special_rx.finditer(chars):
            self._segment(reader, chars[at:hit.start()], out)
            mark = reader.mark()
            self._segment(reader, hit.group(), out)
            reader.back(mark)
            # The special token: one more, and what follows begins anew.
            reader.done, reader.open = reader.tokens + 1, 0
            reader.kind, reader.piece, reader.quote = CLOSED, None, ""
            out[-1] = reader.tokens
            at = hit.end()
        self._segment(reader, chars[at:], out)
        return tuple(out)

    def _segment(self, reader: Reader, chars: str, out: list[int]) -> None:
        """Push raw characters; each prefix is normalised from the last place that no later character changes."""
        normal, begin, mark = self.library.normalizer.normalize_str, 0, reader.mark()
        for k, c in enumerate(chars):
            joins = unicodedata.category(c)[0] == "M" or "ᅠ" <= c <= "ᇿ"
            if not joins:
                begin, mark = k, reader.mark()
            else:
                reader.back(mark)
            for n in normal(chars[begin:k + 1]):
                reader.push(n)
            out.append(reader.tokens)

    def table(self, text: str) -> Table:
        totals, kept, at = array("i"), self.units, 0
        while at < len(text):
            # Units of a block of about BLOCK_CHARS, which ends at white space.
            end = self.space_rx.search(text, at + BLOCK_CHARS)
            end = end.start() if end else len(text)
            for chars in self.unit_rx.findall(text, at, end):
                n = kept.new.get(chars)
                totals.append(self.unit_total(chars) if n is None else n)
            at = end
        return Table(self, text, totals)


class Table:
    """Exact token count of every prefix of one text: a total for each unit, and prefixes of a unit as they are asked for."""

    def __init__(self, counter: Counter, text: str, totals: array):
        self.counter, self.text, self.totals, self.total = counter, text, totals, sum(totals)

    def _units(self) -> Iterator:
        return self.counter.unit_rx.finditer(self.text)

    def at(self, n: int) -> int:
        """Tokens of the first ``n`` characters."""
        before = 0
        for hit, total in zip(self._units(), self.totals):
            if hit.start() >= n:
                return before
            if hit.end() > n:
                return before + self.counter.unit(hit.group())[n - hit.start() - 1]
            before += total
        return before

    def longest_within(self, budget: int) -> int:
        """Characters of the longest prefix with at most ``budget`` tokens."""
        if self.total <= budget:
            return len(self.text)
        if budget < 0:
            return 0
        before = 0
        for hit, total in zip(self._units(), self.totals):
            if before + total > budget:
                # The units after this one begin beyond the budget; within it counts may fall again.
                counts = self.counter.unit(hit.group())
                return hit.start() + next((i for i in range(len(counts), 0, -1) if before + counts[i - 1] <= budget), 0)
            before += total
        return len(self.text)

    def counts(self) -> array:
        """Counts of all prefixes, the empty one first."""
        out, before = array("i", [0]), 0
        for hit, total in zip(self._units(), self.totals):
            out.extend([before] * (hit.start() + 1 - len(out)))
            out.extend([before + n for n in self.counter.unit(hit.group())])
            before += total
        out.extend([before] * (len(self.text) + 1 - len(out)))
        return out


def read_model(path: str = MODEL_PATH) -> bytes:
    if os.path.getsize(path) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is larger than {MAX_MODEL_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


def with_counts(docs: DataFrame, blob: bytes | None = None, text: str = "text", limit: int = LIMIT, store: bool = False,
                keep_text: bool = True) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens``, ``over_limit`` and ``cut_chars`` (characters of the longest
    prefix of at most ``limit`` tokens); ``store`` adds ``prefix_counts``, the count of every prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(blob if blob is not None else read_model())
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
              T.StructField("over_limit", T.BooleanType()), T.StructField("cut_chars", T.LongType())]
    if store:
        fields.append(T.StructField("prefix_counts", T.ArrayType(T.IntegerType())))

    def make():
        counter = per_process("token_counts", hash(shared.value), lambda: Counter(shared.value))

        def work(raws: list[bytes | None]) -> list[pa.Array]:
            rows, stored = [], []
            for raw in raws:
                table = counter.table((raw or b"").decode("utf-8", "replace"))
                rows.append((len(raw or b""), table.total, table.total > limit, table.longest_within(limit)))
                if store:
                    stored.append(table.counts())
            out = [pa.array(column, t) for column, t in zip(zip(*rows) if rows else [()] * 4, [pa.int64(), pa.int64(), pa.bool_(), pa.int64()])]
            return [*out, pa.array([c.tolist() for c in stored], pa.list_(pa.int32()))] if store else out
        return work

    return map_rows(docs, text, fields, make, keep_text)


def tokens_of_prefix(prefix_counts: Column, n_chars: Column) -> Column:
    """Tokens of the first ``n_chars`` characters, from stored counts (null beyond the text)."""
    return F.get(prefix_counts, n_chars)


def longest_prefix(prefix_counts: Column, budget: Column) -> Column:
    """Characters of the longest prefix of at most ``budget`` tokens, from stored counts."""
    return F.array_max(F.transform(prefix_counts, lambda n, i: F.when(n <= budget, i)))


def truncated(docs: DataFrame, blob: bytes | None = None, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``docs`` with each text cut to its longest prefix of at most ``limit`` tokens."""
    cut = with_counts(docs, blob, text, limit)
    return cut.withColumn(text, F.col(text).substr(F.lit(1), F.col("cut_chars").cast("int"))).select(*docs.columns)
