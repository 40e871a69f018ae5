"""Token counts of whole documents by overlap resynchronisation.

A text of up to CHUNK characters is one chunk: it is cut at its proven places, and
pieces that come again are not encoded again (see `Counter.counted`). A longer one is
encoded in chunks that overlap. The token lists of two neighbours are spliced at a place in
the overlap where both have a token boundary and the text has a proven one: a
white-space character ends just before it and another character begins there.
The tokenizer's own pipeline never reads across such a place (see
`Counter.stable`), so what stands before and after it is what the whole text
would give. To be safe against chunk edges, the tokens of both sides around the
place must be the same as well. Where the overlap holds no such place, it is
widened, twofold each time, in the end to the whole text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import table

CHUNK, OVERLAP = 1 << 14, 128
_SAME = 4
_AT_ONCE = 64  # texts or pieces that are encoded in one call
_KNOWN = 1 << 21  # characters of the pieces that a process keeps with their numbers of tokens, and of those it has met once


class Counter:
    """Counts tokens; file: a tokenizers .json or a sentencepiece .model."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.pieces = file.endswith(".model")
        if self.pieces:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=file)
            self.stable = False  # it joins a blank to what follows: no place of a text is outside all tokens, and texts are encoded whole
        else:
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(file)
            self.model.no_truncation()
            self.model.no_padding()
            self.stable = self._splits_at_space()
        self.known: dict[str, int] = {"": 0}  # piece -> its tokens; -1: not to be cut off from what stands before
        self.met: set[str] = set()
        self.sizes = [0, 0]  # characters of both

    def _splits_at_space(self) -> bool:
        """Whether the pre-tokenizer drops white space, so that a token never spans it, and no added token holds any.

        Where a tokenizer keeps white space in its tokens, texts are encoded whole.
        """
        if any(set(t.content) & set(" \t\n") or t.lstrip or t.rstrip for t in self.model.get_added_tokens_decoder().values()):
            return False
        if self.model.pre_tokenizer is None:
            return False
        probe = "ab  cd\n\nef"
        text = self.model.normalizer.normalize_str(probe) if self.model.normalizer else probe
        parts = [p for p, _ in self.model.pre_tokenizer.pre_tokenize_str(text)]
        return parts == ["ab", "cd", "ef"]

    def spans(self, text: str, low: int, since: int = 0) -> tuple[int, list[tuple[int, int, int]]]:
        """How many tokens a chunk at low has before place since, and (id, first character, end) of the others."""
        e = self.model.encode(text, add_special_tokens=False)
        size, n, at = len(e), None, max(0, since - low)
        while n is None and at < len(text):  # white space is in no token
            n, at = e.char_to_token(at), at + 1
        n = size if n is None else n
        while n < size and e.token_to_chars(n)[0] < since - low:
            n += 1
        # the places of these alone are asked for: those of a whole chunk cost a tenth of its encoding
        places = [e.token_to_chars(i) for i in range(n, size)]
        return n, [(i, a + low, b + low) for i, (a, b) in zip(e.ids[n:], places, strict=True)]

    def whole(self, texts: list[str]) -> list[int]:
        if self.pieces:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        encode = getattr(self.model, "encode_batch_fast", self.model.encode_batch)
        return [len(e) for e in encode(texts, add_special_tokens=False)]

    def counted(self, texts: list[str]) -> list[int]:
        """What `whole` gives; pieces between white space that come again are not encoded again.

        The tokenizer never reads across a place with white space before and another character after it, so a
        text has the tokens of its pieces. A piece met the second time is encoded alone and kept; what a text
        holds besides kept pieces is encoded together. A piece that begins with white space of another kind is
        not at such a place, and its text is encoded whole.
        """
        if not self.stable:
            return self.whole(texts)
        if self.sizes[0] > _KNOWN:
            self.known, self.sizes[0] = {"": 0}, 0
        if self.sizes[1] > _KNOWN:
            self.met, self.sizes[1] = set(), 0
        known, met = self.known, self.met
        parts = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        again = set()
        for pieces in parts:
            for p in pieces:
                if p in known or p in again:
                    continue
                if p[0].isspace():
                    known[p] = -1
                    self.sizes[0] += len(p)
                elif p in met:
                    again.add(p)
                else:
                    met.add(p)
                    self.sizes[1] += len(p)
        again = list(again)
        for low in range(0, len(again), _AT_ONCE):
            part = again[low : low + _AT_ONCE]
            known.update(zip(part, self.whole(part), strict=True))
        self.sizes[0] += sum(map(len, again))
        counts = [[known[p] for p in pieces if p in known] for pieces in parts]
        rest = [t if -1 in c else " ".join([p for p in pieces if p not in known]) for t, c, pieces in zip(texts, counts, parts, strict=True)]
        return [n if -1 in c else n + sum(c) for n, c in zip(self.whole(rest), counts, strict=True)]

    def spliced(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        if len(text) <= chunk or not self.stable:
            return self.whole([text])[0]
        total, low = 0, 0  # tokens before low are counted
        while True:
            high = min(len(text), low + chunk)
            if high == len(text):
                return total + self.whole([text[low:]])[0]
            cut, width = None, overlap
            while cut is None and high < len(text):
                start = max(low, high - width)
                end = min(len(text), high + width)
                before, left = self.spans(text[low:high], low, start)
                right = self.spans(text[start:end], start)[1]
                cut = self._common(text, left, right, start, high)
                if cut is None:
                    width, high = 2 * width, min(len(text), high + width)
            if cut is None:
                return total + self.whole([text[low:]])[0]
            total += before + sum(1 for _, a, _ in left if a < cut)
            low = cut

    def _common(self, text: str, left: list, right: list, start: int, high: int) -> int | None:
        """The last place between start and high that is a proven boundary of both lists."""
        after = {a: n for n, (_, a, _) in enumerate(right)}
        for n in range(len(left) - _SAME, _SAME - 1, -1):
            a = left[n][1]
            if a <= start:
                return None
            m = after.get(a)
            if m is None or m < _SAME or a >= high or text[a - 1] not in " \t\n\r" or text[a].isspace():
                continue
            if left[n - _SAME : n + _SAME] == right[m - _SAME : m + _SAME]:
                return a
        return None


_MADE: dict[str, Counter] = {}


def counter(file: str) -> Counter:
    """A tokenizer, loaded once by each Python process."""
    if file not in _MADE:
        _MADE[file] = Counter(file)
    return _MADE[file]


def token_counts(docs: DataFrame, file: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs(doc_id, text) -> one row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Tokens are those of the library for `file`, without begin, end or other
    special tokens; strings of special tokens inside a text are handled as the
    library does by default. A null text counts as an empty one: no bytes, no
    tokens. Repeated rows are counted each; doc_id is passed through, null or
    not. An empty table gives an empty table. Other columns are ignored.
    """

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made = counter(file)
        for texts in batches:
            texts = ["" if t is None else t for t in texts]
            out = [0] * len(texts)
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            for low in range(0, len(short), _AT_ONCE):
                part = short[low : low + _AT_ONCE]
                for i, n in zip(part, made.counted([texts[i] for i in part]), strict=True):
                    out[i] = n
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    out[i] = made.spliced(t, chunk, overlap)
            yield pd.Series(out, dtype="int64")

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    n = F.pandas_udf(count, "long")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), n("text").alias("n_tokens"))
    return docs.select("*", (F.col("n_tokens") > limit).alias("over_limit"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
