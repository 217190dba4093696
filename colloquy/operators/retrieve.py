"""Exact top-k retrieval with dense, sparse or hybrid scores inside candidate pools."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.sources.scratch import stored

from .joins import few, sized_join

QUESTIONS = 8192  # in a packed row, and put together
CHUNKS = 5000
POSTINGS = 1_000_000  # products of weights held at once
COMMON = 200  # a word that makes more products than a COMMON-th of a meeting's pairs is summed by a matrix
WORDS = 512  # columns of such a matrix
COLUMNS = 640  # of the matrices that bound a meeting's sums; words share the last SHARED of them
SHARED = 512
BLOCK = 512  # questions bounded or scored at once
FIRST = 32  # chunks that a question without a useful limit scores before others
MANY = 10  # questions that may have more than a MANY-th of a meeting's chunks score them all, unless these pairs are few
TABLE = 1 << 21  # weights of questions by word, held at once
ENTRIES = 1 << 16  # of chunks, looked up there at once
ALONE = 64  # pairs whose right sides have so many words on average are looked up one by one
LONG = 8  # a chunk of more than LONG times its question's words is not looked up in it, but the other way
EARLY = 32  # one of so many packed rows of chunks is searched first, for the questions' limits; FEW of them or more, with vectors and without
FEW = 4
PIECE = 1 << 19  # bytes of a packed row, about; a task puts several together
FULL = 1 << 23  # of the packed rows of chunks that meet the questions at once
FLOW = 1 << 20  # words that are weighed and packed at once
TOGETHER = 2  # times QUESTIONS that one task holds; a pool's further questions are another task's
SALTS = 4  # parts of a pool's chunks for each core, or more:
PART = 1 << 28  # bytes of packed chunks in one
WEIGHT = 0.3

Weigh = Callable[[pa.RecordBatch], pa.RecordBatch]
Entries = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # see `entries`


def pools(chunks: DataFrame, scope: str, tag: str = "tag") -> DataFrame:
    """chunks with pool_key: their own document's, the one of all, or (auto) both its own and that of answer documents."""
    if scope == "doc":
        return chunks.withColumn("pool_key", F.col(tag))
    if scope == "corpus":
        return chunks.withColumn("pool_key", F.lit("__all__"))
    keys = F.when(F.col("task") == "answer", F.array(F.lit("__answer__"))).otherwise(F.array(F.col(tag)))
    return chunks.withColumn("pool_key", F.explode(keys))


def question_pools(questions: DataFrame, scope: str, tag: str = "tag") -> DataFrame:
    if scope == "auto":
        return questions.withColumn("pool_key", F.when(F.col("task") == "answer", "__answer__").otherwise(F.col(tag)))
    return questions.withColumn("pool_key", F.col(tag) if scope == "doc" else F.lit("__all__"))


def top_k(questions: DataFrame, chunks: DataFrame, k: int = 10, mode: str = "dense", weight: float = WEIGHT, digits: int = 12, weigh: Weigh | None = None) -> DataFrame:
    """qid, tag, chunk_index, score, rank, n_candidates of each question's k best candidates; ties (of scores rounded to `digits`) go by
    tag and chunk_index.

    questions: qid, pool_key, embedding and, unless dense, tokens and weights (arrays). chunks: pool_key, tag, chunk_index and the
    same; if `weigh` is given, it makes tokens and weights of a batch with tokens, where it is packed. A null embedding counts as zeros, null tokens as none. Both sides are packed into rows of about PIECE bytes. A task reads some questions
    of a pool, puts them together and holds them, and then its chunks, of which as many as are FULL meet them at once (`dealt`). A dense meeting is one matrix of scores; others are one of upper bounds, and only pairs that may be
    among the k best, by these and by second bounds of their own, are scored. A task keeps k a question of all its meetings, and only these go on. The driver holds nothing of either side.
    """
    if mode not in ("dense", "sparse", "hybrid"):
        raise ValueError(mode)
    columns = [*(["embedding"] if mode != "sparse" else []), *(["tokens", "weights"] if mode != "dense" else [])]
    scale = 1.0 if mode == "sparse" else weight

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, seen, questions, chunks = None, [], set(), [], []
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(j)[i] for j, c in enumerate(b.schema.names)}
                key = row["pool_key"].as_py(), row["__group"].as_py()
                if key != now:
                    meet(held, chunks)
                    yield from (best.rows() for best, _, _ in held if best.met)
                    now, held, seen, questions, chunks = key, [], set(), [], []
                if row["c_tag"].is_valid:
                    if questions:
                        held.append(asker(questions))
                        questions = []
                    chunks.append(row)
                    if sum(len(r["c_tag"]) for r in chunks) >= CHUNKS or sum(r["c_bytes"].as_py() for r in chunks) >= FULL:
                        meet(held, chunks)
                        chunks = []
                elif row["q_pack"].as_py() not in seen:  # else a copy for other chunks that are this task's too
                    seen.add(row["q_pack"].as_py())
                    if questions and sum(len(r["q_qid"]) for r in [*questions, row]) > QUESTIONS:
                        held.append(asker(questions))
                        questions = []
                    questions.append(row)
        meet(held, chunks)
        yield from (best.rows() for best, _, _ in held if best.met)

    def asker(rows: list[dict[str, pa.Scalar]]) -> tuple[Best, Asked | None, np.ndarray | None]:
        n = [len(r["q_qid"]) for r in rows]
        both = together(rows, "q", ["qid"], columns)
        best = Best(0, both["q_qid"].values, k, digits, np.concatenate([r["q_pack"].as_py() * QUESTIONS + np.arange(m) for r, m in zip(rows, n, strict=True)]))
        for r, begin in zip(rows, np.cumsum(n) - n, strict=True):
            if "q_limits" in r and r["q_limits"].is_valid:
                best.least[begin + r["q_limited"].values.to_numpy()] = r["q_limits"].values.to_numpy()
        dense = None if mode == "sparse" else matrix(both["q_dense"], sum(n))
        return best, None if mode == "dense" else Asked(both, sum(n), scale, dense if dense is not None and dense.shape[1] else None), dense

    def meet(held: list, rows: list[dict[str, pa.Scalar]]) -> None:
        if not held or not rows:
            return
        both = together(rows, "c", ["tag", "chunk_index"], columns, ordered=True)
        nc, tags, indices = len(both["c_tag"]), both["c_tag"].values, both["c_chunk_index"].values
        own = None if mode == "sparse" else matrix(both["c_dense"], nc)
        for best, asked, vectors in held:
            nq = len(best.least)
            dense = None if own is None or not (vectors.shape[1] and own.shape[1]) else (vectors, own)  # one side may have no vector at all
            if mode == "dense":
                blocks = ((i, dense[0][i : i + BLOCK] @ dense[1].T if dense else np.zeros((min(BLOCK, nq - i), nc))) for i in range(0, nq, BLOCK))  # noqa: B023
                best.add(blocks, nc, tags, indices)
            else:
                best.add_bounded(Meeting(both, nq, nc, scale, dense, asked), tags, indices)

    kinds = {"qid": dict(questions.dtypes)["qid"], **{c: dict(chunks.dtypes)[c] for c in ("tag", "chunk_index")}}
    search = lambda met: met.mapInArrow(per_task, f"qid {kinds['qid']}, tag {kinds['tag']}, chunk_index {kinds['chunk_index']}, score double, asked long, met long")
    asked, rows = packed_questions(questions, columns, weigh), stored(packed_chunks(chunks, columns, weigh), "chunks", large_rows=True)
    if mode != "dense":
        dense = F.octet_length("c_dense") > 0 if "embedding" in columns else F.lit(False)
        per = rows.groupBy(dense.alias("dense")).agg(F.count("*").alias("n"), F.sum(F.size("c_tag")).alias("chunks")).collect()
        if sum(r.chunks for r in per) > (EARLY - 1) * CHUNKS:
            # Rows with vectors, which may lie together in few packs, have their own share: without them limits of questions with vectors are far too low.
            n = {r.dense: min(r.n, -(-r.chunks // CHUNKS)) for r in per}
            share = {d: min(EARLY, max(1, n.get(d, 0) // FEW)) for d in (True, False)}
            early = rows.filter(F.pmod(F.xxhash64("c_tag", "c_chunk_index"), F.when(dense, share[True]).otherwise(share[False])) == 0)
            asked = stored(with_limits(asked, search(dealt(asked, early, FEW)), k, digits), "limited", large_rows=True)
    out = search(dealt(asked, rows))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "tag", "chunk_index")
    out = out.withColumn("rank", F.row_number().over(best)).withColumn("n_candidates", F.sum("met").over(Window.partitionBy("qid", "asked")))
    return out.filter((F.col("rank") <= k) & F.col("score").isNotNull()).select("qid", "tag", "chunk_index", "score", "rank", "n_candidates")


def with_limits(asked: DataFrame, found: DataFrame, k: int, digits: int) -> DataFrame:
    """Packed questions with the k-th best score of each among some chunks, in q_limits, and its question's place in q_limited. No chunk with less is among the
    k best of all. They lie a little lower: a pair's score may be rounded otherwise where it is summed in another order."""
    scores = F.sort_array(F.collect_list("score"), asc=False)  # nulls aren't collected
    limits = found.groupBy("asked").agg(F.get(scores, F.lit(k - 1)).alias("limit")).filter("limit is not null")
    per = limits.groupBy(((F.col("asked") - F.col("asked") % QUESTIONS) / QUESTIONS).cast("long").alias("q_pack")).agg(F.collect_list(F.struct((F.col("asked") % QUESTIONS).alias("q"), (F.col("limit") - 2 * 10.0**-digits).alias("limit"))).alias("p"))
    per = stored(per.select("q_pack", F.col("p.q").alias("q_limited"), F.col("p.limit").alias("q_limits")), "limits")
    return sized_join(asked, per, ["q_pack"], "left")


def packed_chunks(chunks: DataFrame, columns: list[str], weigh: Weigh | None = None) -> DataFrame:
    return packed(chunks.select("pool_key", "tag", "chunk_index", *given(columns, weigh)), ["tag", "chunk_index"], columns, CHUNKS, "c_", weigh)


def given(columns: list[str], weigh: Weigh | None) -> list[str]:
    return [c for c in columns if weigh is None or c != "weights"]


def meetings(questions: DataFrame, chunks: DataFrame, columns: list[str]) -> DataFrame:
    return met(packed_questions(questions, columns), packed_chunks(chunks, columns))


def met(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """Each packed row of chunks with each packed row of questions of its pool, and q_pack, a number of the latter. Few questions are broadcast, and chunks don't
    move. Else the chunks of a pool are dealt over parts (SALTS a core) that a copy of its questions meets each, so that no pool is one task's."""
    if few(asked):
        return rows.join(F.broadcast(asked), "pool_key")
    parts = SALTS * rows.sparkSession.sparkContext.defaultParallelism
    rows = stored(rows, "chunks", large_rows=True)
    salts = stored(rows.groupBy("pool_key").agg(F.least(F.count("*"), F.lit(parts)).alias("__salts")), "salts")
    rows = sized_join(rows, salts, ["pool_key"], "inner").withColumn("__salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("__salts"))).drop("__salts")
    copies = sized_join(asked, salts, ["pool_key"], "inner").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__salts") - 1))).drop("__salts")
    by = ["pool_key", "__salt"]
    return rows.repartition(parts, *by).join(copies.repartition(parts, *by).hint("merge"), by).drop("__salt")


def dealt(asked: DataFrame, rows: DataFrame, full: int = 1) -> DataFrame:
    """Packed rows of questions and of chunks, each in a row of its own, so that no row is large and none is sent once for each row it meets. The questions of a pool are
    dealt over groups of about TOGETHER times QUESTIONS, its chunks over salts, as many as have `full` times FULL bytes, and SALTS a core or PART bytes at most; each salt has a copy of each
    group. In a task the questions of a pool and group come first, perhaps more than once, and then its chunks."""
    n, size = rows.agg(F.count("*"), F.sum("c_bytes")).first()
    parts = max(1, min(n, max(SALTS * rows.sparkSession.sparkContext.defaultParallelism, -(-(size or 0) // PART))))
    salts = rows.groupBy("pool_key").agg(F.least(F.ceil(F.sum("c_bytes") / (full * FULL)), F.count("*"), F.lit(parts)).alias("__salts"))
    groups = asked.groupBy("pool_key").agg(F.ceil(F.sum(F.size("q_qid")) / (TOGETHER * QUESTIONS)).alias("__groups"))
    shares = stored(salts.join(groups, "pool_key"), "shares")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    q = sized_join(asked, shares, ["pool_key"], "inner").withColumn("__group", one(F.col("q_pack"), "__groups")).withColumn("__salt", each("__salts"))
    c = sized_join(rows, shares, ["pool_key"], "inner").withColumn("__salt", one(F.monotonically_increasing_id(), "__salts")).withColumn("__group", each("__groups"))
    both = q.unionByName(c, allowMissingColumns=True).drop("__salts", "__groups")
    return both.repartition(parts, "pool_key", "__group", "__salt").sortWithinPartitions("pool_key", "__group", F.col("c_tag").isNotNull()).drop("__salt")


def together(rows: list[dict[str, pa.Scalar]], side: str, ids: list[str], columns: list[str], ordered: bool = False) -> dict[str, pa.Scalar]:
    """One packed row of several, whose rows stand in order of their ids if that is asked."""
    found = {f"{side}_{c}": pa.concat_arrays([r[f"{side}_{c}"].values for r in rows]) for c in ids}
    n = len(found[f"{side}_{ids[0]}"])
    order = pc.sort_indices(pa.table(found), sort_keys=[(c, "ascending") for c in found], null_placement="at_start").to_numpy() if ordered else np.arange(n)
    out: dict[str, pa.Scalar] = {c: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x.take(pa.array(order)))[0] for c, x in found.items()}
    sizes = [len(r[f"{side}_{ids[0]}"]) for r in rows]
    if "embedding" in columns:
        parts = [matrix(r[f"{side}_dense"], m) for r, m in zip(rows, sizes, strict=True)]
        dims = {x.shape[1] for x in parts} - {0}
        if len(dims) > 1:
            raise ValueError("vectors of one table differ in length")
        dim = max(dims, default=0)
        out[f"{side}_dense"] = pa.scalar(np.concatenate([x if x.shape[1] == dim else np.zeros((len(x), dim)) for x in parts])[order].tobytes(), pa.binary())
    if "tokens" in columns:
        words = [r[f"{side}_tokens"].values for r in rows]
        coded = pa.concat_arrays(words).dictionary_encode()
        number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        first = np.cumsum([0, *map(len, words)])
        read = lambda name, kind: [np.frombuffer(r[f"{side}_{name}"].as_py(), kind) for r in rows]
        codes = np.concatenate([number[x + i] for x, i in zip(read("codes", np.int32), first, strict=False)])
        lengths = np.concatenate([np.diff(x, prepend=0) for x in read("ends", np.int64)])
        place, _ = ranges((np.cumsum(lengths) - lengths)[order], lengths[order])
        out[f"{side}_tokens"] = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)[0]
        for name, x in (("codes", codes[place]), ("weights", np.concatenate(read("weights", float))[place]), ("ends", np.cumsum(lengths[order]))):
            out[f"{side}_{name}"] = pa.scalar(x.tobytes(), pa.binary())
    return out


class Best:
    """The k best of each of some questions, of all chunks they have met so far."""

    def __init__(self, pack: int, qids: pa.Array, k: int, digits: int, numbers: np.ndarray | None = None):
        """numbers: of the questions; without them they follow from their packed row's number."""
        self.qids, self.k, self.digits, self.met = qids, k, digits, 0
        self.numbers = pack * QUESTIONS + np.arange(len(qids)) if numbers is None else numbers
        self.least = np.full(len(qids), -np.inf)  # what a chunk must reach to be among them
        self.table: pa.Table | None = None

    def add(self, blocks: Iterator[tuple[int, np.ndarray]], nc: int, tags: pa.Array, indices: pa.Array) -> None:
        """blocks: the number of a first question; scores, a row for it and each after it. Chunks are in order of tag and index, so the first k of equals are enough."""
        self.met += nc
        self.kinds = tags.type, indices.type
        found = []
        for begin, scores in blocks:
            may = np.flatnonzero(scores.max(axis=1) >= self.least[begin : begin + len(scores)] - 10.0**-self.digits) if nc else np.empty(0, int)
            if len(may):
                q, c, best = best_of(np.round(scores[may], self.digits), self.k)
                found.append((begin + may[q], c, best))
        if found:
            self.take(*(np.concatenate(x) for x in zip(*found, strict=True)), tags, indices)

    def add_bounded(self, met: Meeting, tags: pa.Array, indices: pa.Array) -> None:
        """The same of a meeting whose pairs are scored only if their bounds allow a place among the k best. A question with very many such pairs scores FIRST of
        the best bounds before: the k-th of these is its limit from then on. Pairs without a common word are all 0, so the first k of them are enough. What is
        left must pass second bounds, in which other words share a column."""
        self.met += met.nc
        self.kinds = tags.type, indices.type
        met.prepare()
        slack, first = 10.0**-self.digits, min(max(FIRST, self.k), met.nc)
        found = []
        for begin in range(0, met.nq, BLOCK):
            bounds, margin = met.bounds(begin, min(begin + BLOCK, met.nq))
            least = self.least[begin : begin + BLOCK]
            below = lambda rows, least: bounds[rows] < floats_below(least[rows] - slack - margin[rows])[:, None]  # noqa: B023, E731
            may = ~below(slice(None), least)
            q, c = np.divmod(np.flatnonzero(may), max(1, met.nc))
            many = np.flatnonzero(np.bincount(q, minlength=len(bounds)) > max(first, met.nc / MANY))
            if len(many):
                same = (bounds[many] == 0) & met.wordy[begin + many, None]
                bounds[many] = np.where(same & (np.cumsum(same, axis=1) > self.k), -np.inf, bounds[many])
                top = np.argpartition(bounds[many], met.nc - first, axis=1)[:, met.nc - first :]
                top.sort(axis=1)
                scores = np.round(met.scores(begin + np.repeat(many, first), top.ravel()), self.digits)
                found.append((begin + np.repeat(many, first), top.ravel(), scores))
                least = least.copy()
                least[many] = np.fmax(least[many], np.partition(scores.reshape(top.shape), first - self.k, axis=1)[:, first - self.k])
                bounds[many[:, None], top] = -np.inf
                may[many] = ~below(many, least)
                q, c = np.divmod(np.flatnonzero(may), met.nc)
            if len(met.right) > 1:
                bounds, margin = met.second_bounds(begin + q, c)
                left = np.flatnonzero(~(bounds < floats_below(least[q] - slack - margin)))
                q, c = q[left], c[left]
            n = np.bincount(q, minlength=len(least))
            all_of = np.flatnonzero(n > max(first, met.nc / MANY))
            if n[all_of].sum() > len(met.c[0]) / ALONE:  # else their pairs cost less
                x, y, scores = best_of(np.round(met.all_scores(begin + all_of), self.digits), self.k)
                found = [tuple(x[~np.isin(f[0], begin + all_of)] for x in f) for f in found]  # all of them are scored again
                found.append((begin + all_of[x], y, scores))
                left = np.flatnonzero(~np.isin(q, all_of))
                q, c = q[left], c[left]
            found.append((begin + q, c, np.round(met.scores(begin + q, c), self.digits)))
        q, c, best = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = np.flatnonzero((best >= self.least[q]) & (best > -np.inf))
        q, c, best = q[keep], c[keep], best[keep]
        order = np.lexsort((c, -best, q))
        order = order[np.arange(len(order)) - np.searchsorted(q[order], q[order]) < self.k]
        self.take(q[order], c[order], best[order], tags, indices)

    def take(self, q: np.ndarray, c: np.ndarray, best: np.ndarray, tags: pa.Array, indices: pa.Array) -> None:
        keep = best >= self.least[q]
        q, c, best = q[keep], c[keep], best[keep]
        if not len(q):
            return
        new = pa.table({"q": pa.array(q), "score": pa.array(best), "tag": tags.take(pa.array(c)), "chunk_index": indices.take(pa.array(c))})
        if self.table is None:
            self.table = new
        else:
            rows = pa.concat_tables([self.table, new]).combine_chunks()
            order = pc.sort_indices(rows, sort_keys=[("q", "ascending"), ("score", "descending"), ("tag", "ascending"), ("chunk_index", "ascending")], null_placement="at_start")
            q = rows["q"].to_numpy()[order.to_numpy()]
            self.table = rows.take(order.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < self.k)))
        q, score = self.table["q"].to_numpy(), self.table["score"].to_numpy()
        full = np.flatnonzero(np.bincount(q, minlength=len(self.least)) == self.k)
        self.least[full] = score[np.searchsorted(q, full, side="right") - 1]

    def rows(self) -> pa.RecordBatch:
        """qid, tag, chunk_index, score, the question's number and, in `met` of its first row, how many chunks it has met. A question that found
        nothing has a row without a score."""
        q = self.table["q"].to_numpy() if self.table is not None else np.empty(0, int)
        none = np.setdiff1d(np.arange(len(self.least)), q)
        met = np.append(np.where(np.diff(q, prepend=-1) != 0, self.met, 0), np.full(len(none), self.met))
        q = np.append(q, none)
        kinds = {"tag": self.kinds[0], "chunk_index": self.kinds[1], "score": pa.float64()}
        found = [pa.concat_arrays([*(self.table[c].chunks if self.table is not None else []), pa.nulls(len(none), t)]) for c, t in kinds.items()]
        return pa.RecordBatch.from_arrays([self.qids.take(pa.array(q)), *found, pa.array(self.numbers[q]), pa.array(met, pa.int64())], ["qid", "tag", "chunk_index", "score", "asked", "met"])


class Asked:
    """A packed row of questions as its meetings need it. Words are numbered by falling weight of all questions, so what is often looked up lies together."""

    def __init__(self, row: dict[str, pa.Scalar], nq: int, scale: float, dense: np.ndarray | None):
        tokens = row["q_tokens"].values
        self.words, self.nq, self.scale, self.dense = len(tokens), nq, scale, dense
        word, weight, of, ends = entries(row, "q", np.arange(self.words, dtype=np.int32), nq)
        order = np.argsort(-np.bincount(word, np.abs(weight), self.words), kind="stable")
        rank = np.empty(self.words, np.int32)
        rank[order] = np.arange(self.words)
        self.tokens = tokens.take(pa.array(order))  # a copy: a slice would hold its whole batch
        self.entries = rank[word], weight, of, ends
        self.wordy = np.ones(nq, bool) if dense is None else ~dense.any(axis=1)  # whose scores are those of words alone
        self.sides: list[np.ndarray] | None = None

    def prepare(self) -> None:
        """Columns of words, and matrices by them. The words with the largest weights have columns of their own; the others share some, which only adds. Words that
        share a column in the first arrangement hardly do in the second."""
        if self.sides is not None:
            return
        self.width, self.own, self.columns = min(self.words, COLUMNS), self.words, [np.arange(self.words)]
        if self.words > COLUMNS:
            self.own = COLUMNS - SHARED
            rest = np.arange(self.words - self.own)
            self.columns = [np.append(np.arange(self.own), self.own + x % SHARED) for x in (rest, np.random.default_rng(0).permutation(rest))]
        self.sides = self.matrices(self.entries, self.nq, self.scale, self.dense)
        self.norms = [norms(x) for x in self.sides]

    def matrices(self, of: Entries, n: int, scale: float, dense: np.ndarray | None) -> list[np.ndarray]:
        """Of absolute weights, in single precision: one for each arrangement, with vectors beside them."""
        word, weight, row, _ = of
        weight, out = np.abs(weight) * scale, []
        for column in self.columns:
            if not out:
                new = np.empty((n, self.width + (dense.shape[1] if dense is not None else 0)), np.float32)
                new[:, : self.width] = np.bincount(row * self.width + column[word], weight, n * self.width).reshape(n, self.width)
                if dense is not None:
                    new[:, self.width :] = dense
            else:
                new, at = out[0].copy(), np.flatnonzero(column[word] >= self.own)
                new[:, self.own : self.width] = np.bincount(row[at] * SHARED + column[word[at]] - self.own, weight[at], n * SHARED).reshape(n, SHARED)
            out.append(new)
        return out


class Meeting:
    """Questions and chunks of a meeting: bounds of the scores of all pairs, exact scores of some. `asked` may be what was made of the questions before."""

    def __init__(self, row: dict[str, pa.Scalar], nq: int, nc: int, scale: float, dense: tuple[np.ndarray, np.ndarray] | None, asked: Asked | None = None):
        self.asked = asked or Asked(row, nq, scale, dense[0] if dense else None)
        self.nq, self.nc, self.scale, self.dense = nq, nc, scale, dense
        self.wordy = np.ones(nq, bool) if dense is None else self.asked.wordy
        words = row["c_tokens"].values
        self.words = self.asked.words
        known = pc.index_in(words, value_set=self.asked.tokens).fill_null(-1).to_numpy(zero_copy_only=False) if self.words else np.full(len(words), -1)
        self.q, self.c = self.asked.entries, entries(row, "c", known, nc)

    def prepare(self) -> None:
        self.asked.prepare()
        self.right = self.asked.matrices(self.c, self.nc, 1.0, self.dense[1] if self.dense else None)
        width = self.right[0].shape[1]  # without vectors if a side has none
        self.left = [x[:, :width] for x in self.asked.sides]
        long = [float(norms(x).max(initial=0)) for x in self.right]
        self.margins = [(width + 16) * 2.0**-23 * y * x for x, y in zip(self.asked.norms, long, strict=True)]  # of products in single precision

    def bounds(self, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Of questions begin to end and all chunks, and by how much a score may be above."""
        return self.left[0][begin:end] @ self.right[0].T, self.margins[0][begin:end]

    def second_bounds(self, q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs, by the second arrangement."""
        left, right, out = self.left[-1], self.right[-1], np.empty(len(q), np.float32)
        step = max(1, POSTINGS // max(1, left.shape[1]))
        for i in range(0, len(q), step):
            out[i : i + step] = np.einsum("ij,ij->i", left[q[i : i + step]], right[c[i : i + step]])
        return out, self.margins[-1][q]

    def scores(self, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Of pairs."""
        out = self.scale * self.sums(q, c)
        if self.dense is not None:
            step = max(1, POSTINGS // self.dense[0].shape[1])
            for i in range(0, len(q), step):
                out[i : i + step] += np.einsum("ij,ij->i", self.dense[0][q[i : i + step]], self.dense[1][c[i : i + step]])
        return out

    def all_scores(self, questions: np.ndarray) -> np.ndarray:
        """Of some questions and all chunks."""
        word, weight, of, _ = self.q
        number = np.full(self.nq, -1)
        number[questions] = np.arange(len(questions))
        at = np.flatnonzero(number[of] >= 0)
        out = self.scale * products(word[at], weight[at], number[of[at]], *self.c[:3], self.words, len(questions), self.nc)
        return out if self.dense is None else out + self.dense[0][questions] @ self.dense[1].T

    def sums(self, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Sums of products of the weights of shared words, of pairs: a chunk's words are looked up in the question, unless it has more than LONG times as many."""
        out = np.zeros(len(q))
        if self.words:
            short = LONG * np.diff(self.q[3])[q] < np.diff(self.c[3])[c]
            for table, words, a, b, of in ((self.q, self.c, q, c, np.flatnonzero(~short)), (self.c, self.q, c, q, np.flatnonzero(short))):
                of = of[np.argsort(a[of], kind="stable")]
                out[of] = looked_up(table, words, self.words, a[of], b[of])
        return out


def looked_up(left: Entries, right: Entries, words: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products of rows a of left and b of right, in order of a: weights of some rows of left lie in a table by word, where the words of right look."""
    out = np.zeros(len(a))
    if not len(a):
        return out
    (l_word, l_weight, _, l_ends), (r_word, r_weight, _, r_ends) = left, right
    if np.diff(r_ends)[b].mean() >= ALONE:
        begins, ends, edges = r_ends[b].tolist(), r_ends[b + 1].tolist(), [0, *(np.flatnonzero(np.diff(a)) + 1).tolist(), len(a)]
        row = np.zeros(words)
        for i, j in zip(edges, edges[1:], strict=False):
            mine = slice(l_ends[a[i]], l_ends[a[i] + 1])
            np.add.at(row, l_word[mine], l_weight[mine])
            for n in range(i, j):
                out[n] = row.take(r_word[begins[n] : ends[n]]) @ r_weight[begins[n] : ends[n]]
            row[l_word[mine]] = 0
        return out
    rows = max(1, TABLE // words)
    table = np.zeros(rows * words)
    number = np.cumsum(np.diff(a, prepend=a[0]) != 0)
    n_left, n = np.diff(l_ends), np.diff(r_ends)[b]
    upto = np.cumsum(n)
    step = 0
    while step < len(a):
        end = min(int(np.searchsorted(number, number[step] + rows)), int(np.searchsorted(upto, (upto[step - 1] if step else 0) + ENTRIES, side="right")))
        end = max(step + 1, end)
        mine = np.flatnonzero(np.diff(number[step:end], prepend=-1)) + step
        place, of = ranges(l_ends[a[mine]], n_left[a[mine]])
        at = of * words + l_word.take(place)
        np.add.at(table, at, l_weight.take(place))
        m = n[step:end]
        place, of = ranges(r_ends[b[step:end]], m)
        products = table.take(r_word.take(place) + np.repeat((number[step:end] - number[step]) * words, m)) * r_weight.take(place)
        out[step:end] = np.bincount(of, products, end - step)
        table[at] = 0
        step = end
    return out


def entries(row: dict[str, pa.Scalar], side: str, number: np.ndarray, n: int) -> Entries:
    """Word by its number, weight, row of each entry of a side whose word has one; and where each row's begin, and the last ends."""
    word = number[np.frombuffer(row[f"{side}_codes"].as_py(), np.int32)]
    of = np.repeat(np.arange(n), np.diff(np.frombuffer(row[f"{side}_ends"].as_py(), np.int64), prepend=0))
    at = np.flatnonzero(word >= 0)
    of = of[at]
    return word[at], np.frombuffer(row[f"{side}_weights"].as_py(), float)[at], of, np.append(0, np.cumsum(np.bincount(of, minlength=n)))


def ranges(begins: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n numbers from each begin, one range after another, and which range each is of."""
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) + np.repeat(begins - np.cumsum(n) + n, n), of


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of rows."""
    return np.sqrt(np.einsum("ij,ij->i", x, x, dtype=float))


def floats_below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def packed(rows: DataFrame, ids: list[str], columns: list[str], size: int, prefix: str, weigh: Weigh | None = None) -> DataFrame:
    """Rows of up to `size` rows and about PIECE bytes of one pool that lie together, in order of their ids: pool_key; the ids as arrays; vectors as one matrix (`dense`); the distinct
    words (`tokens`), their places there (`codes`) and `weights` one row after another and, in `ends`, where each row's words end; `bytes`, about how many these are."""
    kinds = dict(rows.dtypes)
    schema = ["pool_key string", *(f"{prefix}{c} array<{kinds[c]}>" for c in ids), f"{prefix}bytes long", *([f"{prefix}dense binary"] if "embedding" in columns else []), *([f"{prefix}tokens array<string>", f"{prefix}codes binary", f"{prefix}weights binary", f"{prefix}ends binary"] if "tokens" in columns else [])]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in flowing(whole)):
            table = pa.Table.from_batches([weigh(b) if weigh and b.num_rows else b]).sort_by([("pool_key", "ascending"), *((c, "ascending") for c in ids)], null_placement="at_start").combine_chunks()
            pool = table["pool_key"].combine_chunks().dictionary_encode()
            key = pool.indices.to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            width = np.full(table.num_rows, 24, np.int64)
            for c, each in (("embedding", 8), ("tokens", 12)):
                if c in columns:
                    width += each * table[c].combine_chunks().value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            upto = np.append(0, np.cumsum(width))
            cuts = []
            for i, end in zip(edges, edges[1:], strict=False):
                while i < end:
                    j = max(i + 1, min(end, i + size, int(np.searchsorted(upto, upto[i] + PIECE, side="right")) - 1))
                    cuts.append((i, j))
                    i = j
            for i, j in cuts:
                part = table.slice(i, j - i)
                out = [pa.array([part["pool_key"][0].as_py()], pa.string())]
                for c in ids:
                    x = part[c].combine_chunks()
                    out.append(pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), x))
                out.append(pa.array([upto[j] - upto[i]], pa.int64()))
                if "embedding" in columns:
                    out.append(pa.array([dense_of(part["embedding"].combine_chunks()).tobytes()], pa.binary()))
                if "tokens" in columns:
                    words, weights = part["tokens"].combine_chunks(), part["weights"].combine_chunks()
                    ends = np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
                    coded = words.flatten().dictionary_encode()
                    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
                    out += [pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), pa.array([codes.tobytes()], pa.binary()), pa.array([weights.flatten().to_numpy(zero_copy_only=False).astype(float).tobytes()], pa.binary()), pa.array([ends.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, [c.split(" ")[0] for c in schema])

    return rows.mapInArrow(per_batch, ", ".join(schema))


def flowing(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about FLOW words."""
    if "tokens" not in b.schema.names:
        yield b
        return
    upto = np.append(0, np.cumsum(b.column("tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + FLOW, side="right")) - 1)
        yield b.slice(i, j - i)
        i = j


def packed_questions(questions: DataFrame, columns: list[str], weigh: Weigh | None = None) -> DataFrame:
    """With q_pack, a number of each packed row. Stored twice: as rows, since they are counted and dealt, and packed, since their size decides how they travel."""
    rows = stored(questions.select("qid", "pool_key", *given(columns, weigh)), "asked")
    packs = max(1, -(-rows.count() * 8 // (QUESTIONS * 7)))  # not full, since a hash deals them unevenly and a small rest would meet all chunks too
    return stored(packed(rows.repartition(packs, F.xxhash64("qid")), ["qid"], columns, QUESTIONS, "q_", weigh).withColumn("q_pack", F.monotonically_increasing_id()), "questions", large_rows=True)


def dense_of(vectors: pa.ListArray) -> np.ndarray:
    """A matrix of vectors of one length; zeros for null."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    dim = int(lengths.max()) if len(lengths) else 0
    out = np.zeros((len(vectors), dim))
    if dim:
        if not np.isin(lengths, (0, dim)).all():
            raise ValueError("vectors of one table differ in length")
        out[lengths == dim] = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return out


def matrix(packed_rows: pa.Scalar, n: int) -> np.ndarray:
    x = np.frombuffer(packed_rows.as_py(), float)
    return x.reshape(n, -1)


def shared_weights(row: dict[str, pa.Scalar], nq: int, nc: int) -> np.ndarray:
    """Sums of products of the weights of words that a question and a chunk share."""
    met = Meeting(row, nq, nc, 1.0, None)
    return met.all_scores(np.arange(nq))


def products(q_word: np.ndarray, q_weight: np.ndarray, q_of: np.ndarray, word: np.ndarray, own: np.ndarray, chunk: np.ndarray, words: int, nq: int, nc: int) -> np.ndarray:
    """Of entries of questions and chunks: sums of a matrix. Words that make many products are columns of two matrices, which are
    multiplied. The questions' other words are postings in arrays: one list of (question, weight) by word, so each such word of a chunk adds a slice of it."""
    out = np.zeros(nq * nc)
    order = np.argsort(q_word, kind="stable")
    code, of, weights = q_word[order], q_of[order], q_weight[order]
    begins = np.searchsorted(code, np.arange(words + 1))
    common = np.flatnonzero(np.diff(begins) * np.bincount(word, minlength=words) > nq * nc / COMMON)
    if len(common):
        column = np.full(words, -1)
        column[common] = np.arange(len(common))
        cells, q_column, c_column = out.reshape(nq, nc), column[code], column[word]
        for first in range(0, len(common), WORDS):
            n = min(WORDS, len(common) - first)
            q, c = (q_column >= first) & (q_column < first + n), (c_column >= first) & (c_column < first + n)
            a, b = (np.bincount(x * n + y - first, w, size * n).reshape(size, n) for x, y, w, size in ((of[q], q_column[q], weights[q], nq), (chunk[c], c_column[c], own[c], nc)))
            cells += a @ b.T
        rest = np.flatnonzero(c_column < 0)
        word, chunk, own = word[rest], chunk[rest], own[rest]
    n = np.diff(begins)[word]
    upto = np.cumsum(n)
    step = 0
    while step < len(n):  # postings of about POSTINGS entries at a time
        end = max(step + 1, int(np.searchsorted(upto, (upto[step - 1] if step else 0) + POSTINGS, side="right")))
        m = n[step:end]
        place = np.repeat(begins[word[step:end]] - np.cumsum(m) + m, m) + np.arange(m.sum())
        np.add.at(out, of[place] * nc + np.repeat(chunk[step:end], m), np.repeat(own[step:end], m) * weights[place])
        step = end
    return out.reshape(nq, nc)


def best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of the k largest of each row, the first columns of equals."""
    n = scores.shape[1]
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k]
        row, col = np.nonzero(scores >= least[:, None])
    else:
        row, col = np.divmod(np.arange(scores.size), n)
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    row, col = row[keep], col[keep]
    return row, col, scores[row, col]


def as_arrays(sparse: DataFrame, ids: list[str]) -> DataFrame:
    """ids, tokens, weights from one row per token."""
    pairs = F.array_sort(F.collect_list(F.struct("token", "weight")))
    return sparse.groupBy(*ids).agg(pairs.alias("p")).select(*ids, F.col("p.token").alias("tokens"), F.col("p.weight").alias("weights"))


def sparse_scores(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, tag, chunk_index, sparse of each question and each chunk of its pool that share a word. questions: qid, pool_key, tokens, weights
    (arrays); chunks: pool_key, tag, chunk_index and the same. A sum is whole where it is made: nothing of it is shuffled."""
    met = meetings(questions, chunks, ["tokens", "weights"])
    at = {c: i for i, c in enumerate(met.columns)}

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(j)[i] for c, j in at.items()}
                nq, nc = len(row["q_qid"]), len(row["c_tag"])
                of = Meeting(row, nq, nc, 1.0, None)
                for begin in range(0, nq, BLOCK):
                    scores = of.all_scores(np.arange(begin, min(begin + BLOCK, nq)))
                    q, c = np.nonzero(scores)
                    yield pa.RecordBatch.from_arrays([row["q_qid"].values.take(pa.array(begin + q)), row["c_tag"].values.take(pa.array(c)), row["c_chunk_index"].values.take(pa.array(c)), pa.array(scores[q, c])], ["qid", "tag", "chunk_index", "sparse"])

    kinds = dict(chunks.dtypes)
    return met.mapInArrow(per_batch, f"qid {dict(questions.dtypes)['qid']}, tag {kinds['tag']}, chunk_index {kinds['chunk_index']}, sparse double")


def with_neighbours(chunks: DataFrame, condition: Column, n: int = 0, tag: str = "tag", order: str = "chunk_index") -> DataFrame:
    """Chunks that meet the condition, and n on either side of each within its document."""
    hit = F.max(F.coalesce(condition, F.lit(False)).cast("int")).over(Window.partitionBy(tag).orderBy(order).rowsBetween(-n, n))
    return chunks.withColumn("__hit", hit).filter("__hit = 1").drop("__hit")


def chunk_filter(speaker: str | None = None, recipient: str | None = None, pair: tuple[str, str] | None = None, since=None, until=None, tags: list[str] | None = None, keyword: str | None = None) -> Column:
    """What of chunks' metadata and text must hold, for with_neighbours."""
    out = F.lit(True)
    if speaker is not None:
        out &= F.array_contains("participants", speaker)
    if recipient is not None:
        out &= F.array_contains(F.coalesce("recipients", F.array().cast("array<string>")), recipient)
    if pair is not None:
        out &= F.array_contains("participants", pair[0]) & F.array_contains("participants", pair[1])
    if since is not None:
        out &= F.col("ts_end") >= F.lit(since)
    if until is not None:
        out &= F.col("ts_start") <= F.lit(until)
    if tags is not None:
        out &= F.col("tag").isin(tags)
    return out & F.col("text").contains(keyword) if keyword is not None else out


def uneven_dimensions(vectors: DataFrame, by: str = "model", vector: str = "embedding") -> DataFrame:
    """Models whose vectors differ in length, with the least and the greatest; stacking needs there to be none."""
    sizes = vectors.filter(F.col(vector).isNotNull()).groupBy(by).agg(F.min(F.size(vector)).alias("least"), F.max(F.size(vector)).alias("greatest"))
    return sizes.filter("least < greatest")


def check_dimensions(vectors: DataFrame, by: str = "model", vector: str = "embedding") -> None:
    bad = uneven_dimensions(vectors, by, vector).limit(5).collect()
    if bad:
        raise ValueError(f"vectors of one model differ in length: {[tuple(r) for r in bad]}")
