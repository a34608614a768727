"""Filling fixed-capacity containers (problem 7).

Texts are measured in tokens of a public tokenizer (``byte_bpe_50k``: byte-level BPE, its
vocabulary file is a parameter). A text longer than the container is divided: whole containers
come off its front, the rest is an item like any other. Items are spread evenly over independent
groups of about ``group_windows`` containers, a task each. A group is packed in rounds: items for ``block`` windows
are drawn, and Karmarkar-Karp multiway differencing joins the partial partitions with the largest
imbalance so that their differences cancel. Windows it has filled to within ``slack`` of the capacity
are closed as they are; the items of all others, overfull ones among them, go back and are drawn
again with other ones. No window is ever repaired or filled by another rule. What is left at the end
of a group is divided at once, and the window count rises whenever the capacity is exceeded.

Defined results: null and empty texts (no tokens) are in no container; equal texts are separate
items; no item is divided unless it alone exceeds the container, and no container is overfull.
"""

from __future__ import annotations

import base64
import heapq
import random
from collections.abc import Iterator
from functools import lru_cache
from itertools import count
from operator import itemgetter
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_first = itemgetter(0)
#: Split pattern of the byte-level BPE vocabulary (fixed value of that tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: A vocabulary file is sent to the workers; it may be this large.
MOST_VOCABULARY_BYTES = 64 << 20


def vocabulary_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(data) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary file {path} is too large to send to the workers")
    return data


@lru_cache(maxsize=2)
def encoding(data: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, tokens of every text that has any. The vocabulary is read by the driver and broadcast (size checked)."""
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoding(sent.value)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": [len(e.encode_ordinary(t)) for t in b["text"]]})

    return documents.select("doc_id", "text").filter("text IS NOT NULL AND text <> ''").mapInPandas(measure, "doc_id bigint, tokens int")


def differencing(sizes: list[int], m: int) -> list[tuple[int, ...]]:
    """Karmarkar-Karp: indices of sizes in m sets of nearly equal sums.

    A partial partition holds its sets with their sums less the least one, largest first; sets of sum 0 that hold
    nothing are not written out, so most of the early steps only put two short lists together.
    """
    if not sizes:
        return [()] * m
    tick = count()
    heap = [(-s, next(tick), [(s, (k,))]) for k, s in enumerate(sizes)] if m > 1 else [(0, 0, [(0, tuple(range(len(sizes))))])]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heapreplace
    while len(heap) > 1:
        a, b = pop(heap)[2], heap[0][2]
        alone = m - len(b)  # sets of a that meet an empty one
        if len(a) <= alone:
            joined = a + b
        else:
            # The largest sums of one meet the smallest of the other.
            joined = a[:alone]
            joined += [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[alone:], reversed(b))]  # noqa: B905 - b is the longer
            joined += b[: len(b) - (len(a) - alone)]
        joined.sort(key=_first, reverse=True)
        if len(joined) == m and (least := joined[-1][0]):
            joined = [(s - least, t) for s, t in joined]
        push(heap, (-joined[0][0], next(tick), joined))
    sets = [t for _, t in heap[0][2]]
    return sets + [()] * (m - len(sets))


def pack(items: Iterator[tuple], capacity: int, block: int = 12, slack: float = 0.002, pool: int = 8, counts: dict[str, int] | None = None) -> Iterator[list[tuple]]:
    """Windows of items (size, ...) with no sum beyond the capacity, each exactly as differencing made it.

    ``counts`` takes up the number of windows closed as full (``full``), closed as the fullest of a round without any
    (``best``), and of the last blocks (``last``).
    """
    seen = counts if counts is not None else {}
    rng = random.Random(capacity)  # the same windows whenever a task is repeated
    room = max(1, int(slack * capacity))
    goal = capacity - room / 2
    aim = goal
    fresh: list[tuple] = []  # not drawn since the last shuffle
    back: list[tuple] = []  # from windows that were not closed
    total = 0
    weigh = lambda w: sum(i[0] for i in w)

    def close(kind: str, windows: list[list[tuple]]) -> Iterator[list[tuple]]:
        seen[kind] = seen.get(kind, 0) + len(windows)
        yield from windows

    def round_(m: int) -> Iterator[list[tuple]]:
        """One differencing of the items of about m windows; those without room are closed, the items of the others meet
        other ones in a later round."""
        nonlocal fresh, back, total, aim, idle
        drawn, held = [], 0
        while held < m * aim:
            if not fresh:
                rng.shuffle(back)
                fresh, back = back, fresh
            if not fresh or held + fresh[-1][0] > m * aim:
                break
            held += fresh[-1][0]
            drawn.append(fresh.pop())
        windows = [[drawn[k] for k in w] for w in differencing([i[0] for i in drawn], m)]
        sums = [weigh(w) for w in windows]
        # Windows with a very large item stand apart, so the mean of all is steered until the median is at the goal.
        aim = min(goal * 1.02, max(goal * 0.9, aim + (goal - median(sums)) / 2))
        done = [k for k, s in enumerate(sums) if capacity - room <= s <= capacity]
        kind, idle = "full", 0 if done else idle + 1
        if idle > patience:
            fitting = [k for k, s in enumerate(sums) if 0 < s <= capacity]
            kind, done, idle = "best", sorted(fitting, key=sums.__getitem__)[-1:], 0
        closed = set(done)
        for k, w in enumerate(windows):
            if k in closed:
                total -= sums[k]
            else:
                back += w
        yield from close(kind, [windows[k] for k in done])

    idle, patience = 0, 40
    for i in items:
        back.append(i)
        total += i[0]
        while total > pool * block * capacity:
            yield from round_(block)
    # No more items: rounds go on with what is left while it fills several windows, then everything is divided at
    # once, and the number of windows rises whenever one of them exceeds the capacity.
    while total > LEAST_WINDOWS * capacity:
        yield from round_(max(2, min(block, int(total // capacity) - 1)))
    rest = fresh + back
    if rest:
        m = max(1, -(-total // capacity))
        while True:
            windows = [[rest[k] for k in w] for w in differencing([i[0] for i in rest], m)]
            if all(weigh(w) <= capacity for w in windows):
                break
            m += 1
        yield from close("last", [w for w in windows if w])


#: Below so many windows' worth of items what is left is divided at once.
LEAST_WINDOWS = 6


#: Rows of a group at most, on average over groups (a group is one Arrow table in a task).
GROUP_ROWS = 200_000


def containers(documents: DataFrame, capacities: DataFrame, vocabulary: str = VOCABULARY, group_windows: int = 1024, block: int = 12, slack: float = 0.002) -> DataFrame:
    """name, container_id, doc_id, piece, first_token, n_tokens: where every text, or piece of one, is put."""
    counts = written(token_counts(documents, vocabulary), "tokens")
    total, texts = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).head(1)[0]  # two numbers
    sizes = capacities.filter("name IS NOT NULL AND n_tokens > 0").select("name", F.col("n_tokens").cast("bigint").alias("capacity")).distinct()
    groups = F.greatest(F.lit(1), F.ceil(F.lit(total) / (F.col("capacity") * group_windows)), F.lit(-(-texts // GROUP_ROWS))).cast("bigint")
    pieces = (
        # Every text goes into containers of every size: that is the result, whatever the number of sizes.
        counts.crossJoin(sizes.withColumn("groups", groups))
        .withColumn("whole", F.expr("tokens div capacity"))
        .withColumn("piece", F.explode(F.expr("sequence(0L, greatest(whole - CASE WHEN tokens % capacity = 0 THEN 1 ELSE 0 END, 0L))")))
        .select("name", "capacity", "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), F.expr("CAST(least(capacity, tokens - piece * capacity) AS INT)").alias("n_tokens"), F.pmod(F.xxhash64("doc_id", "piece"), F.col("groups")).alias("grp"))
    )
    full = pieces.filter("n_tokens = capacity").select("name", F.concat_ws(":", F.lit("w"), "doc_id", "piece").alias("container_id"), "doc_id", "piece", "first_token", "n_tokens")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        name, group, capacity = pdf["name"].iat[0], pdf["grp"].iat[0], int(pdf["capacity"].iat[0])
        order = pdf.sort_values(["doc_id", "piece"])
        items = zip(order["n_tokens"].tolist(), order["doc_id"].tolist(), order["piece"].tolist(), order["first_token"].tolist(), strict=True)
        rows = [(name, f"g{group}:{k}", i[1], i[2], i[3], i[0]) for k, w in enumerate(pack(items, capacity, block, slack)) for i in w]
        return pd.DataFrame(rows, columns=["name", "container_id", "doc_id", "piece", "first_token", "n_tokens"])

    # The last piece of each text is the only one below the capacity, so a group has about texts / groups rows. The number of
    # tasks is given: by the size of its rows, which says nothing of the work, Spark would put many groups into one.
    tasks = sizes.agg(F.sum(groups)).head(1)[0][0] or 1  # one number
    rest = pieces.filter("n_tokens < capacity").repartition(int(min(tasks, 10_000)), "name", "grp").groupBy("name", "grp")
    rest = rest.applyInPandas(fill, "name string, container_id string, doc_id bigint, piece bigint, first_token bigint, n_tokens int")
    return full.unionByName(rest)


def fill_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """name, containers, tokens, unused share of each container size."""
    by = packed.groupBy("name").agg(F.count_distinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    return by.join(capacities, "name").select("name", "containers", "tokens", (1 - F.col("tokens") / (F.col("containers") * F.col("n_tokens"))).alias("unused"))


def audit(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """name, texts, overfull, cut, broken for each container size: the number of texts that are packed, of containers beyond
    the capacity, of texts divided though they fit, and of texts of which a part is missing or there twice."""
    by = packed.join(capacities.select("name", F.col("n_tokens").alias("capacity")), "name")
    fill = by.groupBy("name", "container_id").agg((F.sum("n_tokens") > F.max("capacity")).alias("over")).groupBy("name").agg(F.count_if("over").alias("overfull"))
    text = by.groupBy("name", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), F.max("capacity").alias("capacity"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.count_distinct("piece").alias("kinds"))
    whole = text.groupBy("name").agg(
        F.count("*").alias("texts"),
        F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity"))).alias("cut"),
        F.count_if((F.col("end") != F.col("tokens")) | (F.col("kinds") != F.col("pieces"))).alias("broken"),
    )
    return whole.join(fill, "name").select("name", "texts", "overfull", "cut", "broken")
