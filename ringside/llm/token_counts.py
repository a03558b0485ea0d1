"""Operator 6, token counts: prefix dynamic programming.

For every prefix of a text the operator holds the exact number of its tokens, so that truncation and budget questions are
look-ups. The table is built without encoding a prefix:

1. A vocabulary of merges encodes a word canonically if and only if every two neighbouring tokens do so by themselves. So
   of all tokens that end at a place exactly one can follow the last token of the prefix before it, and
   ``tokens(prefix) = tokens(shorter prefix) + 1``. Whether two tokens may be neighbours is worked out from the merges, and
   remembered. A prefix ends a word, so its last token is one with the vocabulary's mark for word ends.
2. No token reaches over a blank: the table of a text is that of its pieces between ASCII blanks, one after another, each
   with the total before it. Pieces' tables are remembered, up to ``MEMORY`` of them.
3. How a text is normalised and cut into words is asked of the library. Where normal forms of two characters melt into
   each other (an accent after its letter), the prefixes between are normalised one by one.

Defined results: a null or empty text has 0 bytes and 0 tokens, and an empty table; strings of special tokens inside a text
are one token, and up to their last character ordinary text, as the library does by default; a token is never added;
repeated rows get equal results; an empty table gives an empty result; further columns are ignored. The vocabulary must be
one of merges with a mark for word ends that drops white space (checked).
"""

from __future__ import annotations

import gc
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from operator import sub

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringside.llm.arrays import lean
from ringside.llm.session import small_batches

#: A piece and the blanks after it. Other white space stays inside pieces.
PIECE = re.compile(r"[^ \t\n\r]+[ \t\n\r]*|[ \t\n\r]+")
BLANKS = " \t\n\r"
#: What may end a word of plain letters without changing it.
ENDS = BLANKS + ".,;:!?"
#: Pieces and pairs of tokens whose answers are remembered; longer pieces than LONG are not.
MEMORY, LONG = 1 << 19, 64
#: Symbols of a word's head.
HEAD = 6
#: Pieces of a text whose tables are put together at a time.
PORTION = 1 << 16
#: A symbol that no merge made; and no token.
SINGLE, NOTHING = (-1, -1, -1), 1 << 19
RUN = re.compile("L+|N|O+")
_tables: dict[str, PrefixTables] = {}


class PrefixTables:
    """Counts of tokens at every prefix, from a vocabulary file's merges."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.mark = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or not self.mark or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError(f"{path}: not a vocabulary of merges with a mark for word ends")
        self.normalise = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
        self._cut = tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        if self.words("a b") != ["a", "b"] or self.words(self.normalise(BLANKS)):
            raise ValueError(f"{path}: tokens of this vocabulary may hold white space")
        self.vocabulary: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocabulary.items()}
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.text_rank = {m: i for i, m in enumerate(merges)}
        #: By numbers of tokens: the rank of every merge, and what each token was made by.
        self.rank = {pair(self.vocabulary[x], self.vocabulary[y]): i for i, (x, y) in enumerate(merges)}
        self.made = [SINGLE] * (max(self.vocabulary.values()) + 1)
        for i, (x, y) in enumerate(merges):
            self.made[self.vocabulary[x + y]] = (i, self.vocabulary[x], self.vocabulary[y])
        self.trie = self._trie()
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {}
        self.heads: dict[str, tuple[list[int], list[int], list[int]]] = {}
        self.of_words: dict[str, list[int]] = {}
        self.chars: dict[str, tuple[str, str]] = {}

    def _trie(self) -> tuple:
        """Tokens from their last symbol to their first, as nodes of (children, tokens inside a word, tokens that end it).

        A node lists all tokens on the way to it, as (length, number), the longest first.
        """
        marks: dict = {}
        for token, number in self.vocabulary.items():
            node = marks
            for c in reversed(token.removesuffix(self.mark)):
                node = node.setdefault(c, {})
            node[int(token.endswith(self.mark))] = number

        def built(node: dict, depth: int, inner: tuple, ending: tuple) -> tuple:
            inner = ((depth, node[0]), *inner) if 0 in node else inner
            ending = ((depth, node[1]), *ending) if 1 in node else ending
            return {c: built(v, depth + 1, inner, ending) for c, v in node.items() if isinstance(c, str)}, inner, ending

        return built(marks, 0, (), ())

    def words(self, text: str) -> list[str]:
        """The words of a normalised text, in the symbols of the vocabulary (one for a byte)."""
        return [w for w, _ in self._cut(text)]

    def symbols(self, token: str) -> list[str]:
        plain = token.removesuffix(self.mark)
        return [*plain[:-1], plain[-1] + token[len(plain) :]]

    def merged(self, symbols: list[str]) -> list[str]:
        """The merges by rank, the leftmost of equals first."""
        while len(symbols) > 1:
            best, at = min((self.text_rank.get((a, b), len(self.text_rank)), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])))
            if best == len(self.text_rank):
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def neighbours(self, left: int, right: int) -> bool:
        """May these tokens stand side by side? With NOTHING on the left: may the right one stand by itself?"""
        key = pair(left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 2 * MEMORY:
                self.pairs.clear()
            if left == NOTHING:
                known = len(self.merged(self.symbols(self.names[right]))) == 1
            else:
                known = self._apart(left, right)
            self.pairs[key] = known
        return known

    def _apart(self, left: int, right: int) -> bool:
        """The merges that made both are taken back, the last one first; none across their border may have come earlier."""
        limit = len(self.rank)
        while True:
            if self.rank.get(pair(left, right), limit) < limit:
                return False
            (a, _, tail), (b, head, _) = self.made[left], self.made[right]
            if a < 0 and b < 0:
                return True
            # Of equal merges the leftmost comes first: one across the border is to the left of one inside the right token.
            limit, left, right = (a, tail, right) if a > b else (b + 1, left, head)

    def extend(self, word: str, last: list[int], count: list[int]) -> list[int]:
        """Counts of word[:n] as a word, for each n that ``last`` and ``count`` (of word[:n] inside a longer word) don't have yet."""
        out = []
        root, pairs, neighbours = self.trie, self.pairs, self.neighbours
        for end in range(len(last), len(word) + 1):
            node, begin = root, end
            while begin:
                begin -= 1
                longer = node[0].get(word[begin])
                if longer is None:
                    break
                node = longer
            # One token only can follow the tokens before it; the longest are tried first.
            for size, token in node[2]:
                before = last[end - size]
                ok = pairs.get(before << 20 | token)
                if neighbours(before, token) if ok is None else ok:
                    out.append(count[end - size] + 1)
                    break
            else:
                raise ValueError(f"no tokens for {word[:end]!r}")
            for size, token in node[1]:
                before = last[end - size]
                ok = pairs.get(before << 20 | token)
                if neighbours(before, token) if ok is None else ok:
                    count.append(count[end - size] + 1)
                    last.append(token)
                    break
            else:
                raise ValueError(f"no tokens for {word[:end]!r}")
        return out

    def fresh(self, word: str) -> list[int]:
        """Counts at every symbol of a word; what many words begin with is counted once."""
        head = self.heads.get(word[:HEAD])
        if head is None:
            last, count = [NOTHING], [0]
            head = self.extend(word[:HEAD], last, count), last, count
            if len(self.heads) > MEMORY // 4:
                self.heads.clear()
            self.heads[word[:HEAD]] = head
        out, last, count = head
        return out + self.extend(word, last.copy(), count.copy()) if len(word) > HEAD else out

    def of_word(self, word: str) -> list[int]:
        """Counts at every symbol of a word."""
        found = self.of_words.get(word)
        if found is None:
            found = self.fresh(word)
            if len(word) <= LONG:
                if len(self.of_words) > MEMORY:
                    self.of_words.clear()
                self.of_words[word] = found
        return found

    def total(self, text: str) -> int:
        """Tokens of a normalised text."""
        return sum(self.of_word(w)[-1] for w in self.words(text))

    def char(self, c: str) -> tuple[str, str]:
        """What runs a character continues (L letters, N none, O others, X if it must be seen with what is around it), and its symbols."""
        found = self.chars.get(c)
        if found is None:
            normal = self.normalise(c)
            kind = "X"
            if len(normal) == 1 and not melts(c) and (own := self.words(normal)):
                kind = "L" if len(self.words("a" + normal)) == 1 else "O" if len(self.words("!" + normal)) == 1 else "N"
            found = self.chars[c] = kind, "".join(own) if kind != "X" else ""
        return found

    def plain(self, text: str) -> list[int]:
        """Counts at every prefix (from one character on) of a text without special tokens."""
        chars = self.chars
        try:
            about = [chars[c] for c in text]
        except KeyError:
            about = [self.char(c) for c in text]
        kinds = "".join([k for k, _ in about])
        if "X" in kinds or "'" in text:
            return self.one_by_one(text)
        out: list[int] = []
        before = 0
        for m in RUN.finditer(kinds):
            symbols = [s for _, s in about[m.start() : m.end()]]
            word = "".join(symbols)
            own = self.of_word(word)
            if len(word) > len(symbols):
                end, each = -1, []
                for s in symbols:
                    end += len(s)
                    each.append(own[end])
                own = each
            out += [before + n for n in own] if before else own
            before = out[-1]
        return out

    def one_by_one(self, text: str) -> list[int]:
        """The same for any text: the last segment (a character and the marks on it) is normalised for each prefix.

        ``tail`` is the last word so far, which later characters may continue; ``before`` counts the words before it.
        """
        out, before, tail, symbols, last, count = [], 0, "", "", [NOTHING], [0]
        for segment in segments(text):
            for n in range(1, len(segment) + 1):
                normal = self.normalise(segment[:n])
                about = [self.char(c) for c in normal]
                kinds = {k for k, _ in about}
                if len(kinds) == 1 and tail and kinds == {self.char(tail[0])[0]} <= {"L", "O"} and (len(tail) > 3 or tail[0] != "'"):
                    size = len(last)
                    longer = symbols + "".join([s for _, s in about])
                    out.append(before + self.extend(longer, last, count)[-1])
                    if n < len(segment):
                        del last[size:], count[size:]
                    else:
                        tail, symbols = tail + normal, longer
                else:
                    whole = tail + normal
                    out.append(before + self.total(whole))
                    if n == len(segment):
                        cut = self._cut(whole)
                        begin = cut[-1][1][0] if cut and cut[-1][1][1] == len(whole) else len(whole)
                        if len(whole) - begin == 1 and whole[:begin].endswith("'") and len(cut) > 1 and cut[-2][1][0] == begin - 1:
                            begin -= 1  # a contraction may be about to form
                        before += self.total(whole[:begin])
                        tail, symbols, last, count = whole[begin:], "".join(self.words(whole[begin:])), [NOTHING], [0]
                        self.extend(symbols, last, count)
        return out

    def of_piece(self, piece: str) -> list[int]:
        if self.special_pattern.search(piece) is None:
            return self.plain(piece)
        out: list[int] = []
        begin = before = 0
        for m in self.special_pattern.finditer(piece):
            out += [before + n for n in self.plain(piece[begin : m.end() - 1])]
            before = (out[m.start() - 1] if m.start() > begin else before) + 1
            out.append(before)
            begin = m.end()
        return out + [before + n for n in self.plain(piece[begin:])]

    def steps(self, piece: str) -> bytes:
        """What each character of a piece and its blanks adds to the count, as 32-bit numbers."""
        core = piece.rstrip(ENDS)
        if not (core.isascii() and core.isalpha()):
            return self._kept(piece, self.of_piece)
        # A word of plain letters, which stops of a sentence and blanks don't change: their tables are kept apart, and that of
        # the whole piece only if the word was met before.
        word = core.lower()
        met = word in self.pieces
        ends = self.ends.get(piece[len(core) :])
        if ends is None:
            ends = self.ends[piece[len(core) :]] = self._steps(piece[len(core) :], self.of_piece)
        found = self._kept(word, self.fresh) + ends
        if met and len(piece) <= LONG:
            self.pieces[piece] = found
        return found

    def _kept(self, piece: str, counts: Callable[[str], list[int]]) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            found = self._steps(piece, counts)
            if len(piece) <= LONG:
                if len(self.pieces) > MEMORY:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def _steps(self, piece: str, counts: Callable[[str], list[int]]) -> bytes:
        bare = piece.rstrip(BLANKS)
        own = counts(bare)
        return array("i", [*map(sub, own, [0, *own]), *[0] * (len(piece) - len(bare))]).tobytes()

    def table(self, text: str) -> np.ndarray:
        """tokens(text[:n]) for n = 0 .. len(text)."""
        pieces, known = PIECE.findall(text), self.pieces
        out = np.zeros(len(text) + 1, np.int32)
        at = 1
        for i in range(0, len(pieces), PORTION):
            some = pieces[i : i + PORTION]
            try:
                steps = b"".join([known[p] for p in some])
            except KeyError:
                steps = b"".join([known.get(p) or self.steps(p) for p in some])
            own = np.frombuffer(steps, "<i4")
            np.cumsum(own, out=out[at : at + len(own)])
            out[at : at + len(own)] += out[at - 1]
            at += len(own)
        return out


_seconds: set[str] = set()


def pair(left: int, right: int) -> int:
    return left << 20 | right


def melts(c: str) -> bool:
    """May a character join the one before it, or change places with it, when a text is normalised?"""
    if not _seconds:
        for i in range(0x110000):
            parts = unicodedata.decomposition(chr(i)).split()
            if len(parts) == 2 and not parts[0].startswith("<"):
                _seconds.add(chr(int(parts[1], 16)))
        _seconds.update(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))
    return unicodedata.combining(c) > 0 or c in _seconds


def segments(text: str) -> Iterator[str]:
    """Parts of a text whose normal forms don't touch: each from a character that joins nothing before it.

    Of many marks of one class in a row, those from the fifth on join nothing either.
    """
    first, same, kind = 0, 0, 0
    for i, c in enumerate(text):
        own = unicodedata.combining(c)
        same = same + 1 if own and own == kind else 0
        kind = own
        if i > first and ((not melts(c) and not (c.isspace() and text[i - 1].isspace())) or same > 4):
            yield text[first:i]
            first = i
    if first < len(text):
        yield text[first:]


def tables(path: str) -> PrefixTables:
    if path not in _tables:
        _tables[path] = PrefixTables(path)
    return _tables[path]


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fitting(table: np.ndarray, budget: int) -> int:
    """The longest prefix of at most ``budget`` tokens."""
    return int(np.flatnonzero(table <= budget)[-1]) if len(table) and budget >= 0 else 0


def _rows(path: str, answer: Callable[[np.ndarray], tuple], kinds: list[pa.DataType], names: list[str]) -> Callable:
    """doc_id, n_bytes and what ``answer`` reads from each text's table."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = tables(path)
        # Many small lists and no cycles: looking for some would take a fifth of the time.
        gc.disable()
        try:
            for batch in batches:
                for i in range(0, batch.num_rows, 64):
                    ids, texts = batch.column(0).slice(i, 64), batch.column(1).slice(i, 64)
                    size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                    found = zip(*(answer(counts.table(t or "")) for t in texts.to_pylist()), strict=True)
                    yield pa.record_batch([ids, size, *(pa.array(x, k) for x, k in zip(found, kinds, strict=True))], ["doc_id", "n_bytes", *names])
        finally:
            gc.enable()

    return run


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def prefix_counts(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and prefix_tokens (tokens of the first n characters, from n = 0 on) of every row."""
    run = _rows(path or default_path(), lambda t: (int(t[-1]), t), [pa.int64(), pa.list_(pa.int32())], ["n_tokens", "prefix_tokens"])
    return _texts(docs, doc_id, text).mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long, prefix_tokens array<int>")


def token_budget(docs: DataFrame, budget: int, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, and fit_chars: how many characters fit into a budget of tokens. The tables stay in the tasks."""
    run = _rows(path or default_path(), lambda t: (int(t[-1]), fitting(t, budget)), [pa.int64(), pa.int64()], ["n_tokens", "fit_chars"])
    return _texts(docs, doc_id, text).mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long, fit_chars long")


def fitting_characters(budget: int | Column) -> Column:
    """The longest prefix, in characters, of at most ``budget`` tokens, from a row's ``prefix_tokens``."""
    places = F.transform("prefix_tokens", lambda n, i: F.when(n <= budget, i))
    return F.coalesce(F.array_max(places), F.lit(0))
