"""BPE encoding and decoding by tree concatenation.

A text is halved by code points again and again, wherever the middle falls, until no part is longer than
LEAF bytes; the words of all leaves are encoded together, and going up the tree the encodings of
neighbours are joined. No token of a vocabulary that drops white space spans ASCII white space, so where some
stands at a join both sides agree as they are. Where a join cuts a word, the window around it grows to the white space on both
sides and is encoded anew. If no white space comes within LEAF bytes (unsplit text), the window grows in steps until its
tokens agree with the left side's and with the right side's over GUARD tokens in a row: a sequence of BPE tokens is the
encoding of its text if every adjacent pair is, and agreement on common tokens makes every adjacent pair
one that a single encoding made. Words recur, so each worker keeps their encodings in a table of bounded size.

Decoding goes from ids alone. Nulls count as empty texts; an empty or blank text has no tokens; repeated rows give repeated
rows; a text is held whole, with its words, in the task that encodes it. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansift.llm.common import map_rows, text_or_empty

LEAF, WINDOW, GUARD, KEPT = 512, 64, 4, 150_000

#: Plain letters (ASCII and Latin-1), then full stops or commas.
SIMPLE = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,]{0,8})")

#: The published byte-level alphabet: visible Latin-1 bytes stand for themselves, others follow from 256 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: b for b in _VISIBLE} | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_VISIBLE)))}


class _Run:
    """A long run without white space whose tokens are known with their places: (id, first, end)."""

    __slots__ = ("text", "tokens")

    def __init__(self, text: str, tokens: list[tuple[int, int, int]]):
        self.text, self.tokens = text, tokens


class TreeEncoder:
    """Encodes texts exactly as the library would encode them whole."""

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW, guard: int = GUARD, kept: int = KEPT):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.leaf, self.window, self.guard, self.kept = max(16, leaf), window, guard, kept  # so that no leaf is empty
        # decimal ids of words, joined by spaces: the newest, and those before them
        self.words: dict[bytes, str] = {}
        self.older: dict[bytes, str] = {}
        self.marks: dict[bytes, str] = {}
        #: How often neighbours were joined: with white space between them, within a word, within unsplit text.
        self.joins = [0, 0, 0]

    def _spans(self, texts: list[str], starts: list[int]) -> list[list[tuple[int, int, int]]]:
        """(id, first, end) of each text's tokens, in code points of the whole piece."""
        out = []
        for start, e in zip(starts, self.tokenizer.encode_batch(texts, add_special_tokens=False)):
            out.append([(i, a + start, b + start) for i, (a, b) in zip(e.ids, e.offsets)])
        return out

    def _together(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, from one call over all of them with spaces between."""
        found: list[list[int]] = [[] for _ in words]
        e = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        k, end = 0, len(words[0]) if words else 0
        for i, (a, _) in zip(e.ids, e.offsets):
            while a > end:
                k += 1
                end += 1 + len(words[k])
            found[k].append(i)
        return found

    def tree(self, data: bytes) -> list[bytes | _Run]:
        """The words and long runs of a text, in order; those words' encodings are known then."""
        depth = max(0, (len(data) - 1).bit_length() - (self.leaf - 1).bit_length())
        while len(data) > self.leaf << depth:
            depth += 1
        cuts = []
        for k in range((1 << depth) + 1):
            c = len(data) * k >> depth
            while c < len(data) and data[c] & 0xC0 == 0x80:  # within a code point
                c += 1
            cuts.append(c)
        # leaves: words, and whether the first and the last touch the leaf's edge
        nodes = [((p := data[a:b]).split(), p[:1].strip() != b"", p[-1:].strip() != b"") for a, b in zip(cuts, cuts[1:])]
        # words that a cut goes through are learnt when they are whole again
        through = [False, *(a[2] and b[1] for a, b in zip(nodes, nodes[1:])), False]
        self._learn({w for k, (words, *_) in enumerate(nodes) for w in words[through[k] : len(words) - through[k + 1]]})
        while len(nodes) > 1:
            cut, halves = [], []
            for left, right in zip(nodes[::2], nodes[1::2]):
                if not (left[2] and right[1]):
                    self.joins[0] += 1
                elif isinstance(left[0][-1], bytes) and isinstance(right[0][0], bytes) and len(left[0][-1]) + len(right[0][0]) <= self.leaf:
                    self.joins[1] += 1
                    cut.append(left[0][-1] + right[0][0])
                else:
                    self.joins[2] += 1
                    halves += [(words, k) for words, k in ((left[0], -1), (right[0], 0)) if isinstance(words[k], bytes)]
            self._learn(set(cut))
            # the halves of a level's unsplit runs, all at once
            texts = [words[k].decode() for words, k in halves]
            for (words, k), text, tokens in zip(halves, texts, self._spans(texts, [0] * len(texts)) if texts else []):
                words[k] = _Run(text, tokens)
            nodes = [self._concatenated(left, right) for left, right in zip(nodes[::2], nodes[1::2])]
        return nodes[0][0]

    def _concatenated(self, left, right):
        (words, first, end), (more, begin, last) = left, right
        if not words or not more:
            return (words or more), bool(words) and first, bool(more) and last  # a side without words is white space
        if not (end and begin):
            return words + more, first, last
        a, b = words.pop(), more[0]
        if isinstance(a, bytes) and isinstance(b, bytes) and len(a) + len(b) <= self.leaf:
            whole = a + b
        else:
            whole = self._joined(*map(self._run, (a, b)))
        words.append(whole)
        words += more[1:]
        return words, first, last

    def _run(self, word: bytes | _Run) -> _Run:
        if isinstance(word, _Run):
            return word
        text = word.decode()
        return _Run(text, self._spans([text], [0])[0])

    def _joined(self, left: _Run, right: _Run) -> _Run:
        mid, text = len(left.text), left.text + right.text
        after = [(i, a + mid, b + mid) for i, a, b in right.tokens]
        return _Run(text, self._join(text, (0, mid, left.tokens), (mid, len(text), after))[2])

    def _join(self, text: str, left, right):
        (a, mid, before), (_, b, after) = left, right
        w = self.window
        while True:
            lo, hi = max(a, mid - w), min(b, mid + w)
            (inner,) = self._spans([text[lo:hi]], [lo])
            cut_l = 0 if lo == a else self._meet(before, inner, lo, mid)
            cut_r = None
            if hi == b:
                cut_r = (len(inner), len(after))
            elif (m := self._meet(after[::-1], inner[::-1], mid, hi)) is not None:
                cut_r = (len(inner) - m[1], len(after) - m[0])
            if cut_l is not None and cut_r is not None:
                i, j = (0, 0) if cut_l == 0 else cut_l
                k, n = cut_r
                if j <= k:
                    return a, b, before[:i] + inner[j:k] + after[n:]
            w *= 2

    def _meet(self, side: list, inner: list, lo: int, hi: int):
        """Counts of tokens of side and inner up to the end of GUARD equal ones in a row between lo and hi, those nearest the join's far end not counted; None if there are none.

        For the right side both lists come reversed, and the run is sought from the outer end too.
        """
        g = self.guard
        at = {t: k for k, t in enumerate(side) if lo <= t[1] and t[2] <= hi}
        run = 0
        for j, t in enumerate(inner):
            k = at.get(t)
            if k is not None and run and at.get(inner[j - 1]) == k - 1:
                run += 1
            else:
                run = 1 if k is not None else 0
            # a token by the window's outer edge may owe its shape to that edge
            if run >= g + 1:
                return k + 1, j + 1
        return None

    def _plain(self, word: bytes) -> str | None:
        """The encoding of a word, if it is plain letters with full stops or commas after them; else None.

        Such letters are NFC already and their lower case doesn't depend on neighbours, so the model alone can be asked.
        """
        if not (m := SIMPLE.fullmatch(word)):
            return None
        letters, marks = m[1].decode().lower().encode(), m[2]
        got = self.words.get(letters) or self.older.get(letters)
        if not got:
            got = " ".join([str(t.id) for t in self.tokenizer.model.tokenize(letters.decode("latin-1").translate(BYTE_LETTERS))])
            self.words[letters] = got
        if marks:
            if marks not in self.marks:
                self.marks[marks] = " ".join(map(str, self.tokenizer.encode(marks.decode(), add_special_tokens=False).ids))
            got = f"{got} {self.marks[marks]}"
        return got

    def _learn(self, words: set[bytes]) -> None:
        """Puts the encodings of words into the table, of those that need the whole library in one call."""
        known, odd = self.words, []
        for w in words.difference(known):
            got = self.older.get(w)
            if got is None:
                got = self._plain(w)
            if got is None:
                odd.append(w)
            else:
                known[w] = got
        for w, ids in zip(odd, self._together([w.decode() for w in odd])):
            known[w] = " ".join(map(str, ids))

    def encode(self, text: str) -> str:
        """Decimal ids joined by a space."""
        words = self.tree(text.encode("utf-8", "surrogatepass"))
        known = self.words
        ids = " ".join([x for x in [known[w] if w.__class__ is bytes else " ".join([str(i) for i, _, _ in w.tokens]) for w in words] if x])
        if len(known) > self.kept:
            self.older, self.words = known, {}
            if len(self.marks) > 1000:
                self.marks.clear()
        return ids


class Decoder:
    """Decodes ids as the library does, with special tokens kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        names = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
        self.names = {str(i): name for name, i in names.items()}

    def decode(self, ids: str) -> str:
        """Of decimal ids joined by a space; ids that the vocabulary lacks are left out, as the library does."""
        if not ids:
            return ""
        found = map(self.names.get, ids.split(" "))
        return " ".join([x for x in found if x is not None])


def encode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, **sizes) -> DataFrame:
    """doc_id, n_tokens, ids_text (decimal ids joined by one space): the whole text's tokens; with decoded, what these ids decode to as well.

    The tokenizer's file must be at tokenizer_path on every executor.
    """

    def run(batches) -> Iterator[list[tuple]]:
        enc = TreeEncoder(tokenizer_path, **sizes)
        back = Decoder(tokenizer_path) if decoded else None
        for rows in batches:
            out, held = [], 0
            for k, text in rows:
                ids = enc.encode(text)
                out.append((k, ids.count(" ") + 1 if ids else 0, ids, *((back.decode(ids),) if back else ())))
                held += 2 * len(ids)
                if held > 8_000_000:
                    yield out
                    out, held = [], 0
            yield out

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_rows(rows, run, f"doc_id long, n_tokens long, ids_text string{', decoded string' if decoded else ''}")


def ids(encoded: DataFrame) -> DataFrame:
    """encode()'s rows with the ids as an array."""
    return encoded.withColumn("ids", F.when(F.col("ids_text") == "", F.array().cast("array<int>")).otherwise(F.split("ids_text", " ").cast("array<int>"))).drop("ids_text")


def decode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded: what the library's decode(ids, skip_special_tokens=False) gives; a null array gives ''."""

    def run(batches) -> Iterator[list[tuple]]:
        back = Decoder(tokenizer_path)
        for rows in batches:
            yield [(k, back.decode(i)) for k, i in rows]

    text = F.coalesce(F.array_join(F.col(ids_col).cast("array<string>"), " "), F.lit(""))
    return map_rows(df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("ids")), run, "doc_id long, decoded string")
