"""Token counts of whole texts under a SentencePiece BPE model, with a shortcut for whole tokens.

Before any text is read, the vocabulary itself is examined (:class:`Proof`):

* which adjacent characters occur inside a piece. Merges only make pieces, so none reaches over two
  characters that no piece holds side by side, and a text may be cut between them. No piece of such a model
  goes on over a space after other characters, so texts are cut before spaces; and words are cut where letters
  meet signs, if the pieces fall apart so;
* which strings of the vocabulary the library encodes alone as one token. Most do, but a string may also be
  out of reach of the merges, so each is tried.

A pre-token that is such a string counts 1 without any work; only the rest is merged, by the library. What
was merged is kept in a bounded table. No text is cut, shortened or left out, and no row leaves its task.

Cases: null and empty texts have 0 tokens and 0 bytes; texts that begin or end with spaces, runs of
spaces, literal U+2581, line breaks and control characters count as the library counts them; strings of
special tokens are ordinary text, as is the library's default; a long text without a space goes through piece
by piece where cuts are proven, else whole; repeated rows are counted each; a null doc_id is carried; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from yieldloom.llm.common import slices, texts, tidy

LIMIT = 4096
SPACE = "▁"
#: Characters of a long text that are looked at together.
PIECE = 1 << 20
MOST_WORDS = 1 << 19


class Proof:
    """What holds for a vocabulary: adjacent characters inside pieces, and strings that are whole tokens."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        self.pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.joined = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        if any(pair[1] == SPACE != pair[0] for pair in self.joined):
            raise ValueError("this vocabulary merges over spaces")
        if any("\n" in p for p in self.pieces):
            raise ValueError("this vocabulary merges line breaks")
        # a line break is a token of its own, so what follows it is encoded as within a text
        self.lead = len(m.encode("\n"))
        #: Whole tokens, without the space in front for those that have one.
        self.after_space = {p[1:] for p in self.pieces if p[0] == SPACE and len(p) > 1 and SPACE not in p[1:] and len(m.encode(p[1:])) == 1}
        self.within = {p for p in self.pieces if SPACE not in p and self.merged_within(p) == 1}
        letters = "".join(map(re.escape, sorted(self._component())))
        self.parts = re.compile(f"[{letters}]+|[^{letters}]+") if letters else re.compile(r"(?s).+")

    def _component(self) -> set[str]:
        """The characters that pieces join, over any number of steps, to the character they join most. No
        piece holds one of them beside another character, spaces in front left aside."""
        near: dict[str, set[str]] = {}
        for a, b in self.joined:
            if a != SPACE:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
        found: set[str] = set()
        ahead = [max(near, key=lambda c: (len(near[c]), c))] if near else []
        while ahead:
            c = ahead.pop()
            if c not in found:
                found.add(c)
                ahead += near[c]
        return found

    def merged_after_space(self, text: str) -> int:
        """Tokens of a space and ``text`` (which is not empty), merged by the library, which puts one in front."""
        return len(self.model.encode(text))

    def merged_within(self, text: str) -> int:
        return len(self.model.encode("\n" + text)) - self.lead


class Counts:
    """Counts tokens of texts. ``known`` holds the tokens of pre-tokens (each with one space in front): 1
    for whole tokens, and what was merged for those that were met a second time."""

    def __init__(self, proof: Proof):
        self.proof = proof
        self.begin()

    def begin(self) -> None:
        self.known = dict.fromkeys(self.proof.after_space, 1)
        self.inner: dict[str, int] = {}
        self.met: set[str] = set()

    def words(self, words: list[str]) -> int:
        """Tokens of pre-tokens, none empty. New ones are merged together in one call, as no merge reaches over
        the spaces between them."""
        found = list(map(self.known.get, words))
        if None not in found:
            return sum(found)
        n = sum(filter(None, found))
        new = []
        for word in [w for w, c in zip(words, found, strict=True) if c is None]:
            if word in self.met:
                n += self._again(word)
            else:
                new.append(word)
        if new:
            self.met.update(w for w in new if len(w) <= 256)
            n += self.proof.merged_after_space(" ".join(new))
            if len(self.met) + len(self.inner) >= MOST_WORDS:
                self.begin()
        return n

    def _again(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            first, *others = self.proof.parts.findall(word)
            n = 1 if first in self.proof.after_space else self.proof.merged_after_space(first)
            self.known[word] = n = n + sum(map(self._within, others))
        return n

    def _within(self, part: str) -> int:
        if part in self.proof.within:
            return 1
        n = self.inner.get(part)
        if n is None:
            self.inner[part] = n = self.proof.merged_within(part)
        return n

    def of(self, text: str) -> int:
        """Tokens of ``text``. The library puts one space in front of a text that isn't empty."""
        if not text:
            return 0
        text = text.replace(SPACE, " ") if SPACE in text else text
        n = begin = 0
        while begin <= len(text):
            # a cut before the first space of a run
            end = begin + PIECE
            if end < len(text):
                end = text.rfind(" ", begin + 1, end)
                while end > begin and text[end - 1] == " ":
                    end -= 1
                if end <= begin:
                    end = text.find(" ", begin + PIECE)
                    end = len(text) if end < 0 else end
            n += self._piece(text[begin:end])
            begin = end + 1
        return n

    def _piece(self, text: str) -> int:
        """``text`` with one space in front."""
        words = text.split(" ")
        if "" not in words:
            return self.words(words)
        n = spaces = 0
        single = []
        for word in words:
            if not word:
                spaces += 1
            elif spaces:
                # a run of spaces goes to the library with what follows it
                n += self.proof.merged_after_space(" " * spaces + word)
                spaces = 0
            else:
                single.append(word)
        if spaces:
            n += self.proof.merged_after_space(" " * (spaces - 1)) if spaces > 1 else 1
        return n + (self.words(single) if single else 0)


@lru_cache(maxsize=2)
def counter(path: str) -> Counts:
    """One for each Python worker and model."""
    return Counts(Proof(path))


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens) for each row of ``docs``."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )

    def run(batches):
        of = counter(model).of
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                n = pa.array([of(t) for t in texts(batch.column("text"))], pa.int64())
                size = pc.cast(pc.fill_null(pc.binary_length(batch.column("text")), 0), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, n, pc.greater(n, limit)], schema.names)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)
