"""SentencePiece BPE encoding with a prefix table, and decoding.

For every prefix of a run of known characters the table holds the one token that ends the prefix's encoding. A token
found by the automaton to end there is that one if the text before it is empty, or if the token that ends the shorter
prefix and it are a compatible pair: no merge, at the time it would have been made, joins characters across their
border. The ids are recovered from the back. Spaces and unknown characters are borders no piece crosses, so runs are
encoded one by one and remembered; the memory is bounded and only saves time.

Defined results: null or empty text has no ids but the end id; unknown characters become their UTF-8 byte pieces;
repeated rows give equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from tarnwick.llm.common import table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Words remembered by a worker.
REMEMBERED = 250_000
#: Characters of the longest word that is remembered, so that unspaced texts take no room.
LONGEST = 64
_RUN = re.compile(" +[^ ]*")
_CODECS: dict[str, PieceCodec] = {}


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCodec:
    """Encoder and decoder for a byte-fallback BPE model with identity normalisation and a dummy prefix."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.end = sp.eos_id()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        self.text = ["" if sp.is_control(i) else p for i, p in enumerate(pieces)]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(pieces) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {pieces[i]: i for i in plain}
        self.blank = {k: self.ids[SPACE * k] for k in range(1, 65) if SPACE * k in self.ids}
        self.known = {p for p in self.ids if len(p) == 1}
        plural = sorted((i for i in plain if len(pieces[i]) > 1 and pieces[i].strip(SPACE)), key=lambda i: (-sp.get_score(i), i))
        #: Merge order; single characters come before all merges.
        self.rank = {p: k for k, p in enumerate(sorted(self.known))}
        single = len(self.rank)
        self.rank |= {pieces[i]: single + k for k, i in enumerate(plural)}
        self.left: dict[str, str] = {}
        self.right: dict[str, str] = {}
        self.auto = ahocorasick.Automaton()
        for p in self.known:
            self.left[p] = self.right[p] = p
            self.auto.add_word(p, p)
        for i in plural:
            p = pieces[i]
            if all(c in self.known for c in p) and (halves := self._halves(p)):
                self.left[p], self.right[p] = halves
                self.auto.add_word(p, p)
        self.auto.make_automaton()
        self.words: dict[str, tuple[str, int, str]] = {}
        self.older: dict[str, tuple[str, int, str]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.id_text = {p: str(i) for p, i in self.ids.items()}

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The last merge that makes the piece out of its characters; None if merging them makes something else."""
        parts = list(piece)
        while len(parts) > 2:
            best, at = min(((self.rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best == 1 << 60:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _joins(self, a: str, b: str) -> bool:
        """Whether BPE on a + b leaves a and b as they are, each being an encoding of itself."""
        rank, limit = self.rank, 1 << 60
        while True:
            if rank.get(a + b, 1 << 60) < limit:
                return False
            if rank[a] > rank[b]:  # take back the younger merge; a crossing merge then must come after it
                limit = rank[a]
                if (half := self.right[a]) == a:
                    return True
                a = half
            else:
                if (half := self.left[b]) == b:
                    if (half := self.right[a]) == a:
                        return True
                    limit, a = rank[a], half
                else:
                    limit, b = rank[b] + 1, half

    def tokens(self, run: str) -> list[str]:
        """Pieces of a run of known characters with at most one leading space mark."""
        n, pairs = len(run), self.pairs
        last: list[str] = [""] * (n + 1)
        for end, piece in self.auto.iter(run):
            end += 1
            if last[end]:
                continue
            start = end - len(piece)
            if start == 0:
                last[end] = piece
            elif before := last[start]:
                ok = pairs.get((before, piece))
                if ok is None:
                    if len(pairs) > REMEMBERED:
                        pairs.clear()
                    ok = pairs[before, piece] = self._joins(before, piece)
                if ok:
                    last[end] = piece
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(last[at])
        out.reverse()
        return out

    def _blanks(self, total: int) -> list[int]:
        """Lengths of the pieces of a run of space marks, whose merges all have one score: the leftmost pair goes first."""
        out: list[int] = []
        while total:
            new, total = 1, total - 1
            while True:
                while out and out[-1] + new in self.blank:
                    new += out.pop()
                if not total or new + 1 not in self.blank:
                    break
                new, total = new + 1, total - 1
            out.append(new)
        return out

    def _word(self, key: str) -> tuple[str, int, str]:
        """(ids as text, number, decoded text) of a run of spaces and what follows; key lacks the run's first space."""
        body = key.lstrip(" ")
        blanks = len(key) - len(body)
        if not blanks and self.known.issuperset(body):
            t = self.tokens(SPACE + body)
            return " ".join([self.id_text[p] for p in t]), len(t), "".join(t).replace(SPACE, " ")
        ids: list[int] = []
        run = SPACE
        for c in body:
            if c in self.known:
                run += c
                continue
            ids += [self.ids[t] for t in self.tokens(run)] if run else []
            ids += [self.byte[b] for b in c.encode()]
            run = ""
        ids += [self.ids[t] for t in self.tokens(run)] if run else []
        if blanks:  # marks that join no word are merged from the left, after all else
            alone = ids[0] == self.ids[SPACE]
            total, rest = (blanks + 1, ids[1:]) if alone else (blanks, ids)
            ids = [self.blank[k] for k in self._blanks(total)] + rest
        return " ".join(map(str, ids)), len(ids), self.decode_run(ids)

    def decode_run(self, ids: list[int]) -> str:
        out, held = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                held.append(b)
                continue
            if held:
                out.append(held.decode(errors="replace"))
                held.clear()
            out.append(self.text[i])
        if held:
            out.append(held.decode(errors="replace"))
        return "".join(out).replace(SPACE, " ")

    def parts(self, text: str) -> list[tuple[str, int, str]]:
        """Encoding of the text by runs of a space and a word."""
        if not text:
            return []
        text = text.replace(SPACE, " ") if SPACE in text else text
        keys = [m[1:] for m in _RUN.findall(" " + text)] if "  " in text or text[0] == " " else text.split(" ")
        if len(self.words) > REMEMBERED:  # two generations: frequent words stay
            self.older, self.words = self.words, {}
        words, older, out = self.words, self.older, []
        for k in keys:
            got = words.get(k)
            if got is None:
                got = older.get(k) or self._word(k)
                if len(k) <= LONGEST:
                    words[k] = got
            out.append(got)
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.parts(text) for i in p[0].split()] + [self.end]

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the dummy prefix's space goes."""
        out = self.decode_run(ids)
        return out[1:] if out.startswith(" ") else out


def codec(path: str) -> PieceCodec:
    """This worker's codec of a model."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def _digests(path: str):
    def run(batches):
        c = codec(path)
        for batch in batches:
            n, ids, back = [], [], []
            for text in batch.column("text").to_pylist():
                parts = c.parts(text or "")
                n.append(sum(p[1] for p in parts) + 1)
                ids.append(hashlib.sha256(" ".join([p[0] for p in parts] + [str(c.end)]).encode()).hexdigest())
                back.append(hashlib.sha256("".join([p[2] for p in parts])[1:].encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_texts(docs: DataFrame, path: str | None = None, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with an array<int> of ids, the end id included, in out_col; a column of that name is replaced."""
    path = path or model_path()
    docs = docs.drop(out_col)

    def run(batches):
        c = codec(path)
        for batch in batches:
            ids = pa.array([c.encode(t or "") for t in batch.column(text_col).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, out_col])

    from pyspark.sql.types import ArrayType, IntegerType, StructType

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(out_col, ArrayType(IntegerType())))


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(_digests(path or model_path()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


ORACLE = None
