"""Operator 2: exact n-gram Jaccard join through a token-group matrix.

Documents become sets of word shingles; equal sets are one class. Similar sets
are put into groups, each group stores the union of its members' tokens, and a
set is compared with a group's members only if its overlap with that union
(counted through the sparse token-group matrix) leaves a link possible.

1. *Prefixes.* Tokens are counted over all sets and put in one order, rarest
   first. Sets of sizes that may link share a token among the first
   ``n - ceil(num * n / den) + 1`` of each. A set none of whose prefix tokens is
   in another set links with nothing but its equals and goes no further: in
   most corpora that is nearly all of them, and their tokens never leave the
   task but for the count. The count is kept by 40 bits of a token's hash; a
   collision moves tokens in the order, the same way for all sets.
2. *Groups.* Every other set joins the group of its most frequent prefix token,
   so near copies meet. Groups are cut into chunks of bounded token count.
3. *Candidates.* A set visits the groups of sets that it shares a prefix token
   with, its own and those of more frequent tokens, so each pair meets once.
4. *Matrix.* In each (chunk, block of visitors) cell the members are dealt into
   subgroups; the matrix of tokens by subgroup bounds each visitor's overlap,
   and only qualifying subgroups are opened and their members counted exactly.
   A cell returns stars, one row per set that it linked, never pairs.
5. *Components* of the stars.

No link is lost: the prefixes are a bound and every later step is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenantscope.session import shared_path

from .blobs import PACKED, give_back, n_parts, pack, part_of, replies_to, statuses, text_buffer, unpack
from .components import connected_components
from .rolling import ranges
from .shingles import set_mark, shingle_sets

#: Tokens of a chunk of a group, and visitors of a cell, at most (about).
CHUNK_TOKENS = 1 << 19
CELL_VISITORS = 4096
#: Members of a subgroup, a column of the token-group matrix.
SUBGROUP = 32
#: Bytes of a cell whose memory a worker may keep for the next one.
KEEP_BYTES = 1 << 20
_RECORD = ("<u4", "u1", "<u4")  # a token's hash (40 bits in two fields), sets that hold it
_SETS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("mark", pa.int64()),
                   ("home", pa.int64()), ("home_sets", pa.int64()), ("shared", pa.list_(pa.int64())), ("tokens", pa.binary())])
_SETS_SQL = ("doc_id long, text_hash long, n_shingles long, mark long, home long, home_sets long, "
             "shared array<long>, tokens binary")


class _Part:
    """The distinct sets of one part and their tokens."""

    def __init__(self, table: pa.Table, words: int, buckets: int):
        sets = shingle_sets(*text_buffer(table.column("__text")), words)
        self.size = np.array([len(s) for s in sets], np.int64)
        self.mark = np.array([set_mark(s) for s in sets], np.uint64)
        _, first = np.unique(self.mark, return_index=True)
        self.first = first[self.size[first] > 0]
        self.sets = [sets[i] for i in self.first]
        flat = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        # One record per distinct 40-bit hash; ``record`` leads from a token to it.
        short, self.record, self.count = np.unique(flat >> np.uint64(24), return_inverse=True, return_counts=True)
        self.short, self.flat = short, flat
        self.bucket = (short % np.uint64(buckets)).astype(np.int64)

    def columns(self) -> tuple[np.ndarray, ...]:
        return ((self.short >> np.uint64(8)).astype("<u4"), self.short.astype("u1"), self.count.astype("<u4"))


def _count(table: pa.Table) -> pa.Table:
    """Answer each token with the number of sets that hold it, if several."""
    table = table.combine_chunks()
    row, (high, low, n) = unpack(table, _RECORD)
    token = (high.astype(np.uint64) << np.uint64(8)) | low
    order = np.argsort(token, kind="stable")
    t = token[order]
    at = np.flatnonzero(np.append(True, t[1:] != t[:-1])[:len(t)])
    if not len(at):
        return replies_to(table, row, np.zeros(0, np.uint32))
    total = np.minimum(np.add.reduceat(n[order].astype(np.int64), at), (1 << 32) - 1)
    answer = np.zeros(len(t), np.uint32)
    answer[order] = np.repeat(np.where(total > 1, total, 0), np.diff(np.append(at, len(t))))
    del token, order, t, at, total, high, low, n
    out = replies_to(table, row, answer)
    give_back()
    return out


def _set_rows(docs: DataFrame, words: int, num: int, den: int, part_bytes: int | None) -> DataFrame:
    """Step 1: one row per document; sets whose prefix holds a token of another
    set carry their tokens (once per part), those tokens and their home group."""
    parts = n_parts(docs, "__text", *([part_bytes] if part_bytes else []))
    src = docs.withColumn("__hash", F.xxhash64("__text")).withColumn("__part", part_of(F.struct("__doc", "__hash"), parts))

    def records(key, table):
        s = _Part(table, words, parts)
        out = pack(s.bucket, key[0].as_py(), s.columns())
        del s
        give_back()
        return out

    def rows(key, table, replies):
        if not table.num_rows:
            return _SETS.empty_table()
        s = _Part(table, words, parts)
        held = np.maximum(statuses(replies, s.bucket, len(s.short)).astype(np.int64), 1)[s.record]
        size = s.size[s.first]
        owner = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((s.flat, held, owner))
        place = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
        prefix = size - -(-num * size // den) + 1
        live = order[(place < prefix[owner]) & (held[order] > 1)]
        # The home of a set: its most frequent shared prefix token (the last).
        own = owner[live]
        at = np.flatnonzero(np.append(True, own[1:] != own[:-1])[:len(own)])
        signed = s.flat.view(np.int64)
        home, home_sets, shared, tokens = ([None] * table.num_rows for _ in range(4))
        for a, b in zip(at.tolist(), np.append(at[1:], len(live))[:len(at)].tolist(), strict=True):
            i = int(s.first[own[a]])
            home[i], home_sets[i] = int(signed[live[b - 1]]), int(held[live[b - 1]])
            shared[i] = signed[live[a:b]].tolist()
            tokens[i] = s.sets[own[a]].astype("<u8").tobytes()
        give_back()
        return pa.table([table.column("__doc"), table.column("__hash"), pa.array(s.size), pa.array(s.mark.view(np.int64)),
                         pa.array(home, pa.int64()), pa.array(home_sets, pa.int64()),
                         pa.array(shared, pa.list_(pa.int64())), pa.array(tokens, pa.binary())], schema=_SETS)

    by_part = src.groupBy("__part")
    answers = by_part.applyInArrow(records, PACKED).groupBy("bucket").applyInArrow(_count, PACKED)
    return by_part.cogroup(answers.groupBy("part")).applyInArrow(rows, _SETS_SQL)


class TokenGroupMatrix:
    """Members of a chunk, their token union, and which subgroups and members
    hold each token (sparse, by token)."""

    def __init__(self, members: list[np.ndarray], subgroup: int = SUBGROUP):
        size = np.array([len(m) for m in members], np.int64)
        self.size = size
        flat = np.concatenate(members)
        order = np.argsort(flat, kind="stable")
        self.union, first = np.unique(flat[order], return_index=True)
        self.bounds = np.append(first, len(flat))
        self.holder = np.repeat(np.arange(len(members)), size)[order]
        # Subgroups: members of like size and first token, side by side.
        by = np.lexsort(([int(m[0]) for m in members], size))
        self.group = np.empty(len(members), np.int64)
        self.group[by] = np.arange(len(members)) // subgroup
        self.n_groups = int(self.group.max()) + 1
        token = np.repeat(np.arange(len(self.union)), np.diff(self.bounds))
        cell = np.unique(token * self.n_groups + self.group[self.holder])
        self.cell_group = cell % self.n_groups
        self.cell_bounds = np.searchsorted(cell // self.n_groups, np.arange(len(self.union) + 1))

    def links(self, q: np.ndarray, num: int, den: int, up_to: int | None = None) -> np.ndarray:
        """Members (before ``up_to``) whose Jaccard similarity with ``q`` is at
        least num / den."""
        at = np.searchsorted(self.union, q)
        known = at < len(self.union)
        known[known] = self.union[at[known]] == q[known]
        at = at[known]
        if den * len(at) < num * len(q):
            return np.zeros(0, np.int64)
        lo, n = self.cell_bounds[at], self.cell_bounds[at + 1] - self.cell_bounds[at]
        bound = np.bincount(self.cell_group[ranges(lo, n)], minlength=self.n_groups)
        ok = den * bound >= num * len(q)
        if not ok.any():
            return np.zeros(0, np.int64)
        lo, n = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        holder = self.holder[ranges(lo, n)]
        common = np.bincount(holder[ok[self.group[holder]]], minlength=len(self.size))
        hit = np.flatnonzero((common > 0) & (den * common >= num * (len(q) + self.size - common)))
        return hit if up_to is None else hit[hit < up_to]


_STARS = pa.schema([("mark", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])


def _cell(num: int, den: int):
    def run(key, table):
        """Step 4, for one chunk and one block of visitors."""
        member = table.column("member").to_numpy(zero_copy_only=False)
        order = np.lexsort((table.column("mark").to_numpy(), ~member))
        mark, copies = (table.column(c).to_numpy()[order] for c in ("mark", "copies"))
        sets = [np.frombuffer(b, "<u8") for b in table.column("tokens").take(pa.array(order)).to_pylist()]
        n = int(member.sum())
        if not n:
            return _STARS.empty_table()
        matrix = TokenGroupMatrix(sets[:n])
        inner = key[2].as_py() == 0  # members meet one another in one cell only
        root = np.arange(len(sets))
        links = np.zeros(len(sets), np.int64)
        for i in range(0 if inner else n, len(sets)):
            hit = matrix.links(sets[i], num, den, i if i < n else None)
            if len(hit):
                links[i] += copies[hit].sum()
                links[hit] += copies[i]
                roots = np.unique(np.append(root[hit], root[i]))
                if len(roots) > 1:
                    root[np.isin(root, roots)] = roots[0]
        used = np.flatnonzero(links)
        if table.nbytes > KEEP_BYTES:
            del matrix, sets
            give_back()
        return pa.table([mark[used], mark[root[used]], links[used]], schema=_STARS)
    return run


def _cells(live: DataFrame, path: str, chunk_tokens: int, cell_visitors: int) -> DataFrame:
    """Step 3: ``mark, home, chunk, block, member``, the sets of each cell. A
    group is known by its token. Its members are cut into chunks by their tokens,
    and its visitors, who come from other groups too, into blocks by number and
    tokens, so that neither side of a cell grows with the group."""
    of = live.select("mark", "n_shingles", F.struct("home_sets", "home").alias("own"), F.explode("shared").alias("token"))
    groups = of.select("token", F.col("own").alias("g")).distinct()
    of.join(groups, "token").where("g >= own").select(
        "mark", "n_shingles", F.col("g.home").alias("home"), (F.col("g") == F.col("own")).alias("inside")).distinct() \
        .write.parquet(f"{path}-visits")
    visits = live.sparkSession.read.parquet(f"{path}-visits")
    parts = lambda n, most: F.ceil(n / F.lit(most)).cast("long")
    cut = visits.groupBy("home").agg(
        F.greatest(parts(F.sum(F.when(F.col("inside"), F.col("n_shingles"))), chunk_tokens), F.lit(1)).alias("chunks"),
        F.greatest(parts(F.count("*"), cell_visitors), parts(F.sum("n_shingles"), chunk_tokens)).alias("blocks"))
    dealt = visits.join(cut, "home").withColumn("at", F.pmod("mark", "chunks")) \
        .withColumn("block", F.pmod(F.xxhash64("mark"), "blocks"))
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    members = dealt.where("inside").select("mark", "home", F.col("at").alias("chunk"), F.explode(numbers(F.col("blocks"))).alias("block"),
                                           F.lit(True).alias("member"))
    # Inside its group a set visits the chunks before its own, elsewhere all.
    guests = dealt.select("mark", "home", F.explode(F.filter(numbers(F.col("chunks")), lambda c: ~F.col("inside") | (c < F.col("at")))).alias("chunk"),
                          "block", F.lit(False).alias("member"))
    return members.unionByName(guests)


def jaccard_classes(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, *, doc_id: str = "doc_id",
                    text: str = "text", part_bytes: int | None = None, chunk_tokens: int = CHUNK_TOKENS,
                    cell_visitors: int = CELL_VISITORS) -> DataFrame:
    """``doc_id long, text_hash long, n_shingles long, component_id long, group_id
    long, n_links long, set_id long`` for every document, exactly.

    Texts are lower-cased (A-Z) and cut at blanks and control breaks; a set
    holds the distinct shingles of ``words`` words, the whole sequence of a
    shorter text, nothing for null, empty or blank ones. Two documents link when
    ``den * intersection >= num * union``. ``component_id`` is the smallest
    doc_id reachable by links, itself included; ``n_links`` counts the documents
    linked directly; ``group_id`` marks components, ``set_id`` equal sets (0: empty) and ``text_hash`` (xxhash64
    of the text) equal texts. A document without
    words is alone. Null ids take part but are nobody's component_id, unless
    all of a component are null; repeated rows link with one another. An empty
    table gives no row. Other columns are ignored.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("__doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    path = shared_path(spark, "ngram-sets")
    _set_rows(src, words, num, den, part_bytes).write.parquet(path)
    rows = spark.read.parquet(path)
    sets = rows.where("n_shingles > 0").groupBy("mark").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    live = rows.where("home is not null").select("mark", "n_shingles", "home", "home_sets", "shared", "tokens")
    live = live.dropDuplicates(["mark"]).join(sets.select("mark", "copies"), "mark")
    cells = _cells(live, path, chunk_tokens, cell_visitors).join(live.select("mark", "copies", "tokens"), "mark")
    stars = f"{path}-stars"
    cells.groupBy("home", "chunk", "block").applyInArrow(_cell(num, den), "mark long, root long, links long").write.parquet(stars)
    found = spark.read.parquet(stars)
    roots = connected_components(found.select(F.col("mark").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("mark").agg(F.sum("links").alias("links"))
    per_set = sets.join(roots.withColumnRenamed("node", "mark"), "mark", "left").join(links, "mark", "left") \
        .select("mark", "copies", "least", F.coalesce("root", "mark").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    least = per_set.groupBy("root").agg(F.min("least").alias("component_id"))
    per_set = per_set.join(least, "root").select("mark", "component_id", F.col("root").alias("group_id"), (F.col("links") + F.col("copies") - 1).alias("n_links"))
    alone = rows.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"),
                                                F.lit(0).cast("long").alias("group_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("set_id"))
    return rows.where("n_shingles > 0").select("doc_id", "text_hash", "n_shingles", "mark").join(per_set, "mark") \
        .select("doc_id", "text_hash", "n_shingles", "component_id", "group_id", "n_links", F.col("mark").alias("set_id")).unionByName(alone)


def op2_ngram_jaccard_join(docs: DataFrame) -> DataFrame:
    """3-word shingles, similarity of 90 in 100."""
    return jaccard_classes(docs, 3, 90, 100).select("doc_id", "n_shingles", "component_id", "n_links")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 90 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) k ON k.a = d.doc_id"""


def one_of_each_group(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) without near
    duplicates: of each component the row with the smallest doc_id stays (nulls
    last; rows of one doc_id by the hash of their text; one of equal rows)."""
    groups = jaccard_classes(docs, words, num, den)
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "text_hash")
    # Documents without words are alone, each by itself.
    at = "__key"
    while at in docs.columns:
        at += "_"
    first = groups.where("set_id <> 0").groupBy("group_id").agg(F.min(key).alias(at)).select(at)
    own = F.struct(F.col("doc_id").isNull().alias("nameless"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"),
                   F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    wordless = F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    kept = docs.where(~wordless).withColumn(at, own).join(first, at, "left_semi").dropDuplicates([at]).drop(at)
    return kept.unionByName(docs.where(wordless))
