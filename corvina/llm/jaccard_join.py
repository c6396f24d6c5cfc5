"""Jaccard self-join of documents on word n-grams with adaptive multi-match prefixes.

Shingles are ordered from rare to frequent; two sets that are alike enough share a shingle among the first few of that order (the prefix), or l shingles if the prefix is longer by l - 1.
1. Chunks of texts, kept once in the shared folder, send their distinct shingles to buckets, which answer with each one's document frequency: unique, or a power of two.
2. A document whose prefix lies within its unique shingles has no partner and drops out. The others keep their shared shingles, rarest first.
3. Equal sets are one class with its smallest doc_id.
4. Documents whose prefixes meet form candidate groups: in each batch of rows a prefix shingle is joined to the smallest document that has it there, and these meet by shingle; so a shingle that a third of all documents hold costs one row a batch.
5. Within a group, each document's prefix is lengthened by the estimated cost of its candidates: the number of documents that its prefix shingles list. A pair is verified only if it shares as many prefix shingles as the shorter of both lengthenings asks for, and if what both share with others could be enough. Pairs that links already connect need no verification.

Groups of up to `block` documents are verified at once. Larger ones are dealt into blocks, and each block is joined by the group's PIVOTS documents with the fewest unique shingles: copies link through these, and what moves is in proportion to the group. Only documents that are not yet linked with most of their group (step 6) meet the others, and only those whose number of shingles allows a link. Links come out as forests, never as all pairs. What remains quadratic is a large group without links whose documents still share prefixes and sizes: each of its blocks meets each other, in tasks of bounded size.

Defined cases: null and empty texts, and texts without words, have no shingles and no links; fewer words than n are one shingle, the whole sequence; a text of any length is one set of all its shingles; rows with equal doc_id are one document in links and keep their own n_shingles; of documents in a group the smallest doc_id names it, so there are no ties; a null doc_id has a null component; other columns are ignored; an empty table gives an empty result. Shingles are equal if their 64-bit hashes are (48 bits of these within step 5).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _chunks as ck
from ._common import LOWER, SLICE_BYTES, U64, binaries, buckets, grams, groups, mix, pack, ragged, table, through_storage, trim, unpack, word_hashes, words
from .components import components, forest

N, PERCENT = 4, 85
#: Documents of a group that are verified at once; larger groups are dealt into blocks of about that many, each with PIVOTS of the group's documents.
BLOCK, PIVOTS = 160, 64
#: Most documents on each side of a task that compares documents left over with their group.
LARGEST = 4096
#: Bytes of text whose shingles are dealt out together.
CHUNK_BYTES = 3 << 20
#: Longest lengthening of a prefix, and the candidates per document from which it is lengthened.
MOST_MATCHES, CHEAP = 6, 32
#: Parts in which the members of a class of equal sets are joined to it.
SALTS = 16
_KEY_BYTES = ck.KEY_BITS // 8


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingles, document of each), by document and then by value."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    h = word_hashes(data, starts, ends)
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    g = grams(h, n)
    at = np.flatnonzero(doc[: len(g)] == doc[n - 1 : n - 1 + len(g)])
    values, docs = [g[at]], [doc[at]]
    for size in range(1, n):  # whole sequences that are shorter
        of = np.flatnonzero(counts == size)
        if len(of):
            values.append(mix(grams(h, size)[first[of]] + U64(size)))
            docs.append(of)
    value, doc = np.concatenate(values), np.concatenate(docs)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    keep = np.append(True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])) if len(value) else np.zeros(0, bool)
    return value[keep], doc[keep]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, U64), np.cumsum(values, dtype=U64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _chunk_keys(c: ck.Chunk, n: int):
    """(distinct keys of a chunk, in order; how many documents have each; key of each shingle; document of each)"""
    parts = []
    first = 0
    while first < len(c.doc_id):  # in slices, so that work space is bounded
        last = max(first + 1, int(np.searchsorted(c.offsets, c.offsets[first] + SLICE_BYTES, "right")) - 1)
        value, doc = shingles(c.data[c.offsets[first] : c.offsets[last]], c.offsets[first : last + 1] - c.offsets[first], n)
        parts.append((value, (doc + first).astype(np.int32)))
        first = last
    value = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, U64)
    doc = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int32)
    del parts
    keys, place, counts = np.unique(ck.short(value), return_inverse=True, return_counts=True)
    return keys, counts, place, doc, value


def _send_keys(n: int, dealt: int):
    def run(batches):
        for c in ck.stored(batches):
            keys, counts, *_ = _chunk_keys(c, n)
            bounds = ck.bucket_bounds(keys, dealt)
            out = []
            for b in range(dealt):
                s = slice(bounds[b], bounds[b + 1])
                if s.start < s.stop:
                    more = np.flatnonzero(counts[s] > 1)
                    out.append((c.name, b, pack(more=more.astype(np.uint32), counts=counts[s][more].astype(np.uint32), **ck.sorted_planes(keys[s]))))
            yield ck.rows(out)

    return run


def _frequencies(group: pa.Table) -> pa.Table:
    """For each chunk's list, 0 for a shingle that one document has, else 1 + the power of two of how many have it."""
    names, of, found = ck.split_bucket(group)
    keys = [ck.from_sorted(x) for x in found]
    counts = []
    for x, k in zip(found, keys, strict=True):
        c = np.ones(len(k), np.int64)
        c[x["more"]] = x["counts"]
        counts.append(c)
    flat, each = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(flat, kind="stable")
    begin = ck.runs(flat[order])
    total = np.add.reduceat(each[order], begin)
    level = np.where(total > 1, 1 + np.floor(np.log2(total)), 0).astype(np.uint8)
    answer = np.empty(len(flat), np.uint8)
    answer[order] = np.repeat(level, np.diff(np.append(begin, len(flat))))
    parts = np.split(answer, np.cumsum([len(k) for k in keys])[:-1])
    return ck.as_table([(c, b, pack(at=np.flatnonzero(a).astype(np.uint32), level=a[a > 0])) for c, b, a in zip(names, of, parts, strict=True) if a.any()])


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """Of how many shingles in the common order any two sets alike enough must share one."""
    return n - (n * percent + 99) // 100 + 1


def to_bytes(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES]).tobytes()


def from_bytes(raw) -> np.ndarray:
    out = np.zeros((len(raw) // _KEY_BYTES, 8), np.uint8)
    out[:, :_KEY_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, _KEY_BYTES)
    return out.reshape(-1).view("<u8")


ROWS = "doc_id long, n long, sums string, lone long, keys binary, head array<long>"


def _shared(n: int, dealt: int, percent: int):
    """A row for each document: its number of shingles; and for those that can have a partner, the set's sum, how many shingles nobody else has, the others, rarest first, and those of them in the prefix."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        replies = {b: unpack(v) for b, v in zip(answers.column("bucket").to_pylist(), binaries(answers.column("payload")), strict=True)}
        (c,) = ck.stored(texts.to_batches())
        keys, _, place, doc, values = _chunk_keys(c, n)
        bounds = ck.bucket_bounds(keys, dealt)
        level = np.zeros(len(keys), np.uint8)
        for b, x in replies.items():  # shingles that are not named are unique
            level[bounds[b] + x["at"].astype(np.int64)] = x["level"]
        own = level[place]
        edge = np.searchsorted(doc, np.arange(len(c.doc_id) + 1))
        size = np.diff(edge)
        low, high = _sums(mix(values), edge), _sums(mix(values ^ U64(0x5851F42D4C957F2D)), edge)
        shared = np.concatenate(([0], np.cumsum(own > 0)))
        lone = size - (shared[edge[1:]] - shared[edge[:-1]])
        prefix = prefix_size(size, percent)
        sums, kept, heads = ([None] * len(size) for _ in range(3))
        for k in np.flatnonzero((size > 0) & (lone < prefix) & ~c.null).tolist():
            s = slice(edge[k], edge[k + 1])
            at = np.flatnonzero(own[s])
            key, rank = keys[place[s]][at], own[s][at]
            key = key[np.lexsort((key, rank))]
            sums[k] = f"{int(size[k])}:{int(low[k]):x}:{int(high[k]):x}"
            kept[k] = to_bytes(key)
            heads[k] = key[: prefix[k] - lone[k]].astype(np.int64)
        del keys, place, doc, values, level, own, replies
        trim()
        return pa.table([pa.array(c.doc_id, mask=c.null), pa.array(size.astype(np.int64)), pa.array(sums, pa.string()), pa.array(lone.astype(np.int64)), pa.array(kept, pa.binary()), pa.array(heads, pa.list_(pa.int64()))], ["doc_id", "n", "sums", "lone", "keys", "head"])

    return run


def links_within(ids: np.ndarray, n: np.ndarray, lone: np.ndarray, keys: list[np.ndarray], percent: int, sides: np.ndarray | None = None, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A forest of the links among the given sets; with sides, only pairs of different sides are looked at; those of equal `known` are connected already."""
    count = len(ids)
    shared = n - lone  # no pair has more in common
    need = (n * percent + 99) // 100
    most = np.minimum(MOST_MATCHES, need)
    # the longest prefixes, with how far each entry lengthens its own
    taken = np.clip(n - need + most - lone, 0, [len(k) for k in keys])
    base = np.clip(n - need + 1 - lone, 0, None)
    token = np.concatenate([k[:t] for k, t in zip(keys, taken.tolist(), strict=True)])
    of = np.repeat(np.arange(count), taken)
    bounds = np.concatenate(([0], np.cumsum(taken)))
    rank = np.arange(len(of)) - bounds[of]
    level = np.maximum(1, rank - base[of] + 2)
    uniq, place = np.unique(token, return_inverse=True)
    order, edges = groups(place, len(uniq))
    listed = np.diff(edges)
    # candidates that each lengthening of a prefix would bring, over the matches it asks for
    cost = np.stack([np.bincount(of, np.where(level <= k, listed[place] - 1, 0), count) / k for k in range(1, MOST_MATCHES + 1)])
    wanted = np.where(cost[0] <= CHEAP, 1, 1 + np.argmin(cost, axis=0))
    wanted = np.minimum(wanted, most)
    label = np.arange(count) if known is None else np.unique(known, return_inverse=True)[1]
    in_order = [np.sort(k) for k in keys]
    found = []
    for r in range(count):
        mine = slice(bounds[r], bounds[r + 1])
        mine = np.flatnonzero(level[mine] <= wanted[r]) + mine.start
        lists = place[mine]
        entry = order[ragged(edges[lists], listed[lists])]
        other = of[entry]
        asked = np.minimum(wanted[r], wanted[other])
        ok = (other > r) & (np.maximum(level[entry], np.repeat(level[mine], listed[lists])) <= asked)
        if not ok.any():
            continue
        seen = np.bincount(other[ok], minlength=count)
        hit = np.flatnonzero(seen)
        hit = hit[seen[hit] >= np.minimum(wanted[r], wanted[hit])]
        hit = hit[((100 + percent) * np.minimum(shared[hit], shared[r]) >= percent * (n[hit] + n[r])) & (label[hit] != label[r])]
        if sides is not None:
            hit = hit[sides[hit] != sides[r]]
        step = 256
        for at in range(0, len(hit), step):
            part = hit[at : at + step]
            part = part[label[part] != label[r]]
            if not len(part):
                continue
            flat = np.concatenate([keys[s] for s in part])
            mine_keys = in_order[r]
            k = np.searchsorted(mine_keys, flat)
            same = (mine_keys[np.minimum(k, len(mine_keys) - 1)] == flat).astype(np.int64)
            both = np.add.reduceat(same, np.concatenate(([0], np.cumsum([len(keys[s]) for s in part])[:-1])))
            for s in part[(100 + percent) * both >= percent * (n[part] + n[r])].tolist():
                if label[s] != label[r]:
                    found.append((int(ids[r]), int(ids[s])))
                    label[label == label[s]] = label[r]
    return found


def _verify(percent: int):
    def run(group: pa.Table) -> pa.Table:
        comp = group.column("comp").to_numpy()
        ids, n, lone, side, known = (group.column(c).to_numpy() for c in ("doc_id", "n", "lone", "side", "label"))
        large = group.column("large").to_numpy(zero_copy_only=False)
        raw = binaries(group.column("keys"))
        order = np.lexsort((ids, comp))
        begin = ck.runs(comp[order])
        found: list[tuple[int, int, bool]] = []
        for a, b in zip(begin.tolist(), [*begin.tolist()[1:], len(order)], strict=True):
            at = order[a:b]
            keys = [from_bytes(raw[i]) for i in at.tolist()]
            sides = side[at]
            found += [(x, y, bool(large[at[0]])) for x, y in links_within(ids[at], n[at], lone[at], keys, percent, sides if len(set(sides.tolist())) > 1 else None, known[at])]
        trim()
        x, y, z = zip(*found, strict=True) if found else ((), (), ())
        return pa.table([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(z, pa.bool_())], ["a", "b", "large"])

    return run


def _met(batches):
    """Of the prefixes of a batch: (token, smallest document that has it), and a forest (null, node, root) of the documents that meet here."""
    for batch in batches:
        heads = batch.column(1)
        doc = np.repeat(batch.column(0).to_numpy(), heads.value_lengths().to_numpy())
        token = heads.flatten().to_numpy()
        order = np.lexsort((doc, token))
        begin = ck.runs(token[order])
        first = doc[order[begin]]
        each = np.repeat(first, np.diff(np.append(begin, len(order))))
        far = doc[order] != each
        node, root = forest(doc[order][far], each[far])
        none = np.zeros(len(begin) + len(node), bool)
        none[len(begin) :] = True
        tokens = np.concatenate((token[order[begin]], np.zeros(len(node), np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(tokens, mask=none), pa.array(np.concatenate((first, node))), pa.array(np.concatenate((first, root)))], ["token", "a", "b"])


def _salted(rows: DataFrame, one: DataFrame, on: list[str]) -> DataFrame:
    """rows joined to `one`, which has a row for each key, in SALTS parts: a key may hold a third of all rows."""
    parts = one.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(parts, [*on, "salt"]).drop("salt")


def sets(docs: DataFrame, n: int = N, percent: int = PERCENT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """ROWS of all documents, kept in the shared folder."""
    dealt = buckets(docs)
    texts = ck.text_rows(docs, chunk_bytes)
    answers = texts.mapInArrow(_send_keys(n, dealt), ck.SCHEMA).groupBy("bucket").applyInArrow(_frequencies, ck.SCHEMA)
    return through_storage(texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_shared(n, dealt, percent), ROWS), "jaccard")


def _groups(first: DataFrame) -> DataFrame:
    """(doc_id, comp, size) of documents whose prefixes meet others', directly or not."""
    met = through_storage(first.select("doc_id", "head").mapInArrow(_met, "token long, a long, b long"), "jaccard-prefixes")
    tokens = met.where("token IS NOT NULL").selectExpr("token", "a AS doc_id")
    least = tokens.groupBy("token").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("top")).where("b <> top").drop("top")
    edges = tokens.join(least, "token").where("doc_id <> b").selectExpr("doc_id AS a", "b").unionByName(met.where("token IS NULL").select("a", "b"))
    grouped = through_storage(components(edges), "jaccard-groups")
    sizes = grouped.groupBy("root").agg((F.count("*") + 1).alias("size"))
    members = grouped.unionByName(grouped.select(F.col("root").alias("node"), "root").distinct())
    return _salted(members.withColumnRenamed("node", "doc_id"), sizes, ["root"]).withColumnRenamed("root", "comp")


def _class(n: Column) -> Column:
    """A number of shingles, in steps of a hundredth."""
    return F.floor(100 * F.log(n)).cast("int")


def _left_over(large: DataFrame, near: DataFrame, percent: int, block: int) -> DataFrame:
    """Tasks that compare the documents of large groups that are not linked with most of their group with those whose size allows a link."""
    label = components(near.where("large").select("a", "b")).selectExpr("node AS doc_id", "root AS label")
    state = large.select("comp", "doc_id", "n", "lone").join(label, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    state = through_storage(state.withColumn("class", _class(F.col("n"))), "jaccard-state")
    top = state.groupBy("comp", "label").count().groupBy("comp").agg(F.max_by("label", F.struct("count", "label")).alias("top"))
    shared = F.col("n") - F.col("lone")
    rest = _salted(state, top, ["comp"]).where("label <> top")
    fewest, most = F.ceil(percent * F.col("n") / 100), F.floor(((100 + percent) * shared - percent * F.col("n")) / percent)
    rest = rest.where(most >= fewest).select("comp", "doc_id", "label", F.explode(F.sequence(_class(fewest), _class(most))).alias("class"))
    of_all = state.groupBy("comp", "class").agg(F.count("*").alias("all"))
    plan = rest.groupBy("comp", "class").agg(F.count("*").alias("some")).join(of_all, ["comp", "class"])
    each = F.least(F.lit(LARGEST), F.greatest(F.lit(block * 4 // 5), F.ceil(F.col("all") / 20)))
    plan = plan.select("comp", "class", F.ceil(F.col("some") / each).cast("int").alias("rows"), F.ceil(F.col("all") / each).cast("int").alias("columns"))
    plan = through_storage(plan, "jaccard-plan")
    own = lambda of: F.pmod(F.xxhash64("doc_id"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = _salted(rest, plan, ["comp", "class"]).select("comp", "class", "doc_id", "label", F.lit(0).alias("side"), own("rows").alias("row"), every("columns").alias("column"))
    right = _salted(state, plan, ["comp", "class"]).select("comp", "class", "doc_id", "label", F.lit(1).alias("side"), every("rows").alias("row"), own("columns").alias("column"))
    tasks = left.unionByName(right).select("comp", "doc_id", "label", "side", F.concat_ws("-", "comp", "class", "row", "column").alias("task"))
    return tasks.join(large.select("doc_id", "n", "lone", "keys"), "doc_id").withColumn("large", F.lit(True))


def links(rows: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) whose components are those of all links: 100 * intersection >= percent * union; rows come from sets()."""
    shared = rows.where("sums IS NOT NULL")
    classes = shared.groupBy("sums").agg(F.min("doc_id").alias("b"), F.count("*").alias("of"))
    equal = _salted(shared.select("doc_id", "sums"), classes.where("of > 1").drop("of"), ["sums"]).where("doc_id <> b").selectExpr("doc_id AS a", "b").distinct()
    first = shared.join(classes.selectExpr("b AS doc_id", "sums"), ["doc_id", "sums"], "left_semi").drop("sums")
    members = through_storage(_groups(first), "jaccard-members")
    found = first.drop("head").join(members.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")), "doc_id").drop("size")
    found = found.withColumns({"side": F.lit(0), "label": F.col("doc_id"), "large": F.col("blocks") > 1})
    out = ["task", "comp", "doc_id", "n", "lone", "keys", "side", "label", "large"]
    small = found.where("blocks = 1").withColumn("task", F.pmod(F.xxhash64("comp"), F.lit(8 * buckets(rows))).cast("string")).select(out)
    large = found.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    any_large = not members.where(F.col("size") > block).isEmpty()
    tasks = small
    if any_large:
        large = through_storage(large, "jaccard-large")
        name = F.concat_ws("-", "comp", "block").alias("task")
        order = Window.partitionBy("comp").orderBy("lone", F.xxhash64("doc_id"), "doc_id")
        pivots = large.select("comp", "doc_id", "lone").withColumn("k", F.row_number().over(order)).where(F.col("k") <= min(PIVOTS, block)).select("doc_id")
        pivots = large.join(pivots, "doc_id", "left_semi").withColumn("into", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("into <> block").drop("block").withColumnRenamed("into", "block")
        tasks = small.unionByName(large.withColumn("task", name).select(out)).unionByName(pivots.withColumn("task", name).select(out))
    near = through_storage(tasks.groupBy("task").applyInArrow(_verify(percent), "a long, b long, large boolean"), "jaccard-near")
    edges = equal.unionByName(near.select("a", "b"))
    if any_large:
        more = _left_over(large, near, percent, block).groupBy("task").applyInArrow(_verify(percent), "a long, b long, large boolean")
        edges = edges.unionByName(more.select("a", "b"))
    return edges


def join(docs: DataFrame, n: int = N, percent: int = PERCENT, chunk_bytes: int = CHUNK_BYTES, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text)."""
    rows = sets(docs, n, percent, chunk_bytes)
    classes = components(links(rows, percent, block)).selectExpr("node AS doc_id", "root")
    return rows.selectExpr("doc_id", "n AS n_shingles").join(classes, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def first_of_each(docs: DataFrame, n: int = 5, percent: int = 80, chunk_bytes: int = CHUNK_BYTES, block: int = BLOCK) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, with all their columns; rows without a doc_id stay."""
    gone = components(links(sets(docs, n, percent, chunk_bytes), percent, block)).selectExpr("node AS doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[pos:pos + 3], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 2))) AS pos FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), either AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, either.b FROM reach JOIN either ON reach.b = either.a
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = w.doc_id
"""
