"""Ops 3 and 7: unigram segmentation with a SentencePiece vocabulary.

The best segmentation of a text is the sequence of pieces with the largest sum of log scores (the scores in the model
file). Ties follow the tokenizer: at each end the piece that starts first wins, and a character without a piece of its own
is unknown, 10 below the lowest score, and becomes one byte piece for each of its bytes. Sums are kept in double precision.

Both operators work on runs: no piece of the vocabulary joins a character before a word mark, or anything with a line
end, so a text's best segmentation is that of its runs, and each worker segments a distinct short run once. Where a vocabulary
has such pieces, texts are segmented whole.

Op 3 counts pieces only: an Aho-Corasick automaton enumerates the matches at each end and a dynamic program carries the best
score and its piece count. Op 7 encodes: a double-array trie is walked from each start, the best piece at each end is
kept and the path is read back. Decoding joins the pieces' bytes, turns word marks into blanks and drops the first.

Defined results: null and empty texts have no pieces; repeated rows are each encoded; very long texts and runs are segmented
whole (only runs up to RUN_KEPT characters are remembered); a text that holds the word mark itself decodes to a blank there.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, field, read

MARK = "▁"
UNKNOWN_PENALTY = 10.0
RUN_KEPT, RUNS_KEPT = 64, 500_000


class Vocabulary:
    """Pieces, scores and special ids of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.pieces = [model.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.scores = {self.pieces[i]: (i, float(model.get_score(i))) for i in plain}
        self.byte_ids = {int(self.pieces[i][3:-1], 16): i for i in ids if model.is_byte(i)}
        self.unknown_id = model.unk_id()
        self.unknown_score = min(s for _, s in self.scores.values()) - UNKNOWN_PENALTY
        self.bytes_of = [bytes([int(p[3:-1], 16)]) if model.is_byte(i) else b" \xe2\x81\x87 " if model.is_unknown(i) else b"" if model.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        probe = "  a\n b  c"
        self.normalize = None if model.normalize(probe) == MARK + probe.replace(" ", MARK) else model.normalize
        self.runs = self.normalize is None and not any(re.search(f"[^{MARK}]{MARK}", p) or ("\n" in p and len(p) > 1) for p in self.scores)

    def unknown(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()] if len(self.byte_ids) == 256 else [self.unknown_id]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Runs(dict):
    """Run -> what `segment` makes of it; None for the empty run, which stands for a double blank."""

    def __init__(self, segment):
        self.segment = segment
        self[""] = None

    def __missing__(self, key: str):
        value = self.segment(key if key[0] == "\n" else MARK + key)
        if len(key) <= RUN_KEPT:
            if len(self) > RUNS_KEPT:
                self.clear()
                self[""] = None
            self[key] = value
        return value


def over_runs(vocab: Vocabulary, segment, join):
    """A function from a text to join(of the parts that segment returns)."""
    known = _Runs(segment)
    pattern = re.compile(f"{MARK}+[^{MARK}\\n]*|[^{MARK}\\n]+|\\n")

    def apply(text: str):
        if not text:
            return join([])
        if not vocab.runs:
            return join([segment(vocab.normalize(text) if vocab.normalize else MARK + text.replace(" ", MARK))])
        if MARK not in text:
            try:
                return join(map(known.__getitem__, text.replace("\n", " \n").split(" ")))
            except TypeError:  # a double blank
                pass
        return join(map(segment, pattern.findall(MARK + text.replace(" ", MARK))))

    return apply


def counter(vocab: Vocabulary):
    """Count-only Viterbi: a function from a normalised string to its number of pieces."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for piece, (_, score) in vocab.scores.items():
        automaton.add_word(piece, (len(piece), score))
    automaton.make_automaton()
    single, unknown_score = {p for p in vocab.scores if len(p) == 1}, vocab.unknown_score

    def count(text: str) -> int:
        n = len(text)
        best, pieces, start_of, done = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1), 0

        def unknowns(upto: int) -> None:
            for i in range(done, upto):
                if text[i] not in single and (start_of[i + 1] < 0 or best[i] + unknown_score > best[i + 1]):
                    best[i + 1], pieces[i + 1], start_of[i + 1] = best[i] + unknown_score, pieces[i] + len(vocab.unknown(text[i])), i

        for last, (length, score) in automaton.iter(text):
            if last > done:
                unknowns(last)
                done = last
            end, start = last + 1, last + 1 - length
            s = best[start] + score
            if start_of[end] < 0 or s > best[end] or s == best[end] and start < start_of[end]:
                best[end], pieces[end], start_of[end] = s, pieces[start] + 1, start
        unknowns(n)
        return pieces[n]

    return count


def double_array(keys: list[tuple[str, int]]) -> tuple[dict[str, int], array, array, array]:
    """Codes of characters and base, check, value of a double-array trie: child = base[node] + code if check[child] is node."""
    codes = {c: k + 1 for k, c in enumerate(sorted({c for w, _ in keys for c in w}))}
    root: dict = {}
    for w, v in keys:
        node = root
        for c in w:
            node = node.setdefault(codes[c], {})
        node[0] = v
    size = 1 << 16
    base, check, value = array("i", [0]) * size, array("i", [-1]) * size, array("i", [-1]) * size
    check[0] = 0
    queue, first = [(0, root)], 1
    for at, node in queue:
        value[at] = node.get(0, -1)
        children = sorted(c for c in node if c)
        if not children:
            continue
        b = begun = max(first - children[0], 1)
        while True:
            while b + children[-1] >= len(check):
                base.extend([0] * size)
                check.extend([-1] * size)
                value.extend([-1] * size)
            if check[b + children[0]] < 0 and all(check[b + c] < 0 for c in children):
                break
            b += 1
        if b - begun > 50:  # what lies before is nearly full
            first = b + children[0]
        base[at] = b
        for c in children:
            check[b + c] = at
            queue.append((b + c, node[c]))
    return codes, base, check, value


def encoder(vocab: Vocabulary, trie=None):
    """Unigram Viterbi: a function from a normalised string to its ids, as bytes of 32-bit integers."""
    codes, base, check, value = trie or double_array([(p, i) for p, (i, _) in vocab.scores.items()])
    score_of = {i: s for i, s in vocab.scores.values()}
    unknown_score = vocab.unknown_score

    def encode(text: str) -> bytes:
        n = len(text)
        best, start_of, id_of = [0.0] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        code = [codes.get(c, 0) for c in text]
        for start in range(n):
            node, here, alone = 0, best[start], False
            for end in range(start, n):
                c = code[end]
                child = base[node] + c
                if not c or child >= len(check) or check[child] != node:
                    break
                node = child
                i = value[node]
                if i >= 0:
                    alone = alone or end == start
                    s = here + score_of[i]
                    if start_of[end + 1] < 0 or s > best[end + 1]:
                        best[end + 1], start_of[end + 1], id_of[end + 1] = s, start, i
                if not base[node]:
                    break
            if not alone and (start_of[start + 1] < 0 or here + unknown_score > best[start + 1]):
                best[start + 1], start_of[start + 1], id_of[start + 1] = here + unknown_score, start, -1
        path, end = [], n
        while end:
            path.append((start_of[end], id_of[end]))
            end = start_of[end]
        out = array("I")
        for start, i in reversed(path):
            if i < 0:
                out.extend(vocab.unknown(text[start]))
            else:
                out.append(i)
        return out.tobytes()

    return encode


def decode(vocab: Vocabulary, ids) -> str:
    """The text of ids: bytes joined, word marks as blanks, without the first."""
    text = b"".join(map(vocab.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def count_tokens(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_tokens, the number of pieces of the whole text."""

    def make():
        vocab = vocabulary(path)
        count = over_runs(vocab, counter(vocab), sum)
        return lambda texts: {"n_tokens": [count((t or b"").decode()) for t in texts]}

    return append_columns(docs, text, make, [field("n_tokens", "bigint")], keep)


def encode_texts(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, ids: bool = True) -> DataFrame:
    """docs with n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), decoded_equal and, if asked for, ids."""
    vocab = vocabulary(path)
    trie = docs.sparkSession.sparkContext.broadcast(double_array([(p, i) for p, (i, _) in vocab.scores.items()]))  # the vocabulary's size

    def make():
        own = vocabulary(path)
        encode = over_runs(own, encoder(own, trie.value), b"".join)

        def apply(texts):
            out = {"n_tokens": [], "ids_crc32": [], "decoded_equal": [], "ids": []}
            for t in texts:
                plain = (t or b"").decode()
                data = encode(plain)
                got = memoryview(data).cast("I")
                out["n_tokens"].append(len(got))
                out["ids_crc32"].append(zlib.crc32(data))
                out["decoded_equal"].append(decode(own, got) == plain)
                out["ids"].append(array("i", got) if ids else None)
            return out

        return apply

    fields = [field("n_tokens", "bigint"), field("ids_crc32", "bigint"), field("decoded_equal", "boolean")] + [field("ids", "array<int>")] * ids
    return append_columns(docs, text, make, fields, keep)


def decode_ids(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """tokens with text, decoded from a column of id arrays."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def text(column):
        vocab = vocabulary(path)
        return column.map(lambda x: None if x is None else decode(vocab, x))

    return tokens.withColumn("text", text(F.col(f"`{ids}`")))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_tokens."""
    return count_tokens(read(spark, sf_dir, "documents"), model_path(), keep=["doc_id"])


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every document: doc_id, n_tokens, ids_crc32, decoded_equal."""
    return encode_texts(read(spark, sf_dir, "documents"), model_path(), keep=["doc_id"], ids=False)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's doc_id, ids, their number and check sum, and whether they decode to the text."""
    return encode_texts(docs, model_path(), keep=["doc_id"])
