"""Session memories of excluded concepts, and the correction of query vectors by them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import MemoryConfig
from ..functions import scalars as S
from ..sources.tables import written
from .intervals import stabbed
from .joins import met

CURRENT, PERSISTENT = "current", "persistent"


def negative_events(beliefs: DataFrame) -> DataFrame:
    """Negatives by the retrieval turn that they act on: feedback after turn t is known at turn t + 1."""
    attribute = F.trim("attribute")
    return beliefs.where("polarity = 'negative'").select("session_id", (F.col("feedback_turn") + 1).alias("turn"), "idx", attribute.alias("attribute"), S.canonical(attribute).alias("concept"), "confidence")


def bundle_at(states: DataFrame, beliefs: DataFrame) -> DataFrame:
    """The beliefs that each state reads (none at turn 0): an equi-join at an offset of one turn."""
    ev = beliefs.select("session_id", (F.col("feedback_turn") + 1).alias("turn"), "polarity", "idx", "attribute", "confidence")
    return states.select("session_id", "turn").join(ev, ["session_id", "turn"], "left")


def versions(events: DataFrame) -> DataFrame:
    """What is remembered of each concept from one change to the next: a row for each turn that tells of it, valid until the next one less 1.

    The greatest confidence and the first place so far, the latest surface; `until` is null for the last.
    """
    by = W.partitionBy("session_id", "concept").orderBy("turn", "idx")
    so_far = by.rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = events.select(
        "session_id", "concept", F.col("attribute").alias("surface"), F.max("confidence").over(so_far).alias("confidence"), F.first(F.struct(F.col("turn").alias("at"), "idx")).over(so_far).alias("first"),
        F.col("turn").alias("updated"), F.lead("turn").over(by).alias("next"),
    )
    return seen.where("next IS NULL OR next > updated").withColumn("until", F.col("next") - 1).drop("next")


def memory(states: DataFrame, events: DataFrame, kind: str = PERSISTENT) -> DataFrame:
    """A row for each concept that a state remembers, without a cap: greatest confidence, latest surface, age.

    Rows are made in proportion to a session's events and to what its states remember, not to their product.
    """
    s = states.select("session_id", "turn").distinct()
    if kind == PERSISTENT:
        met = stabbed(s, versions(events), "session_id", "turn", "updated", "until")
    else:
        ord_ = F.struct(F.col("turn").alias("at"), "idx")
        now = events.groupBy("session_id", "turn", "concept").agg(F.max("confidence").alias("confidence"), F.min(ord_).alias("first"), F.max_by("attribute", ord_).alias("surface"))
        met = s.join(now.hint("merge"), ["session_id", "turn"]).withColumn("updated", F.col("turn"))
    return met.select("session_id", "turn", "concept", "surface", "confidence", F.col("first.at").alias("created"), "updated", (F.col("turn") - F.col("updated")).alias("age"), "first")


def weighted(mem: DataFrame, mode: str, decay: float) -> DataFrame:
    return mem.withColumn("weight", S.memory_weight(mode, F.col("confidence"), F.col("age"), decay))


#: Components of all vectors of a vocabulary up to which it is broadcast (32 MB).
BROADCAST_COMPONENTS = 1 << 22


def summed(rows: DataFrame, vocabulary: DataFrame, keys: list[str]) -> DataFrame:
    """The sum of weight * unit(vector of surface) of each key, from (keys, surface, weight) rows: a memory's concepts, in their order.

    Rows are dealt by key before they have vectors, if the vocabulary may be broadcast; a larger one meets them by surface, whatever the surfaces' numbers of rows.
    """
    size = vocabulary.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    units = vocabulary.select(F.col("text").alias("surface"), S.unit(F.col("vector")).alias("vector"))
    if size.n * (size.d or 0) <= BROADCAST_COMPONENTS:
        vectors = rows.repartition(*keys).join(F.broadcast(units), "surface", "left").withColumn("vector", known(F.col("vector"), F.col("surface")))
    else:
        vectors = met(written(rows, "remembered"), units, "surface", F.concat(F.lit("no vector for "), "surface"))
    held = vectors.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("surface", "weight", "vector"))).alias("held"))
    zero = F.transform(F.col("held")[0]["vector"], lambda x: F.lit(0.0))
    return held.select(*keys, F.aggregate("held", zero, lambda a, r: F.zip_with(a, r["vector"], lambda x, y: x + r["weight"] * y)).alias("aggregate"))


def known(vector: Column, text: Column) -> Column:
    """vector, or an error that names the text which has none."""
    return F.when(vector.isNull(), F.raise_error(F.concat(F.lit("no vector for "), text)).cast("array<double>")).otherwise(vector)


def correct(states: DataFrame, mem: DataFrame, vocabulary: DataFrame, config: MemoryConfig, keys: tuple[str, ...] = ("session_id", "turn")) -> DataFrame:
    """states with vector = unit(unit(q) - lambda * unit(sum of weighted concepts)); unit(q) where there is no memory."""
    keys = list(keys)
    both = states.join(summed(mem.select(*keys, "surface", "weight"), vocabulary, keys).hint("merge"), keys, "left")
    q, m = S.unit(F.col("query_vector")), F.col("aggregate")
    moved = S.unit(F.zip_with(q, S.unit(m), lambda x, y: x - F.lit(config.negative_weight) * y))
    return both.withColumn("vector", F.when(m.isNotNull() & (S.norm(m) > 0), moved).otherwise(q)).drop("aggregate", "query_vector")


def queries(states: DataFrame, beliefs: DataFrame, vocabulary: DataFrame, config: MemoryConfig, method: str, mode: str = "full") -> DataFrame:
    """(run_id, session_id, turn, target_index, vector) of a method: h0 joins no beliefs at all."""
    base = states.select("session_id", "turn", "target_index", "query_vector")
    if method == "h0":
        return base.select(F.lit(method).alias("run_id"), "session_id", "turn", "target_index", S.unit(F.col("query_vector")).alias("vector"))
    mem = weighted(memory(states, negative_events(beliefs), method), mode, config.recency_decay)
    return correct(base, mem, vocabulary, config).withColumn("run_id", F.lit(method))


def ablation_queries(states: DataFrame, beliefs: DataFrame, vocabulary: DataFrame, config: MemoryConfig, modes: tuple[str, ...] = ("uniform", "confidence", "recency", "full")) -> DataFrame:
    """Persistent queries under all weight modes from one memory: each row is sent once a mode."""
    mem = memory(states, negative_events(beliefs))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("run_id"), S.memory_weight(m, F.col("confidence"), F.col("age"), config.recency_decay).alias("weight")) for m in modes)))
    mem = mem.select("session_id", "turn", "surface", each.alias("w")).select("session_id", "turn", "surface", "w.*")
    base = states.select("session_id", "turn", "target_index", "query_vector", F.explode(F.array(*map(F.lit, modes))).alias("run_id"))
    return correct(base, mem, vocabulary, config, ("run_id", "session_id", "turn"))


def add_stats(events: DataFrame) -> DataFrame:
    """How many concepts each turn's negatives added and updated, without a cap: nothing is overridden or evicted then.

    For the counts under a cap, or of both polarities, see turn_stats.
    """
    first = F.row_number().over(W.partitionBy("session_id", "concept").orderBy("turn", "idx")) == 1
    counts = events.withColumn("new", first).groupBy("session_id", "turn").agg(F.count_if("new").alias("added"), F.count_if(~F.col("new")).alias("updated"))
    return counts.withColumns({"overridden": F.lit(0).cast("long"), "evicted": F.lit(0).cast("long")})


def turn_stats(folded: DataFrame) -> DataFrame:
    """(session_id, turn, added, updated, overridden, evicted) of a folded memory's turns that have a memory."""
    return folded.groupBy("session_id", "turn").agg(*(F.max(c).cast("long").alias("updated" if c == "changed" else c) for c in COUNTS))


def override_log(folded: DataFrame) -> DataFrame:
    """(session_id, turn, concept, from, to, n) of each override, in its turn's order."""
    return folded.groupBy("session_id", "turn").agg(F.first("matched").alias("m")).select("session_id", "turn", F.posexplode("m").alias("n", "x")).select("session_id", "turn", "n", "x.*")


def diagnostics(states: DataFrame, mem: DataFrame) -> DataFrame:
    """Memory sizes of all states, by polarity, and how many overrides the entries have seen; empty memories count.

    A memory without polarities is one of negatives, which nothing overrides.
    """
    if "polarity" not in mem.columns:
        mem = mem.withColumns({"polarity": F.lit("negative"), "overrides": F.lit(0)})
    sizes = mem.groupBy("session_id", "turn").agg(F.count("*").alias("size"), F.count_if(F.col("polarity") == "positive").alias("positive"), F.count_if(F.col("polarity") == "negative").alias("negative"), F.sum("overrides").alias("overrides"))
    return states.select("session_id", "turn").join(sizes.hint("merge"), ["session_id", "turn"], "left").fillna(0, ["size", "positive", "negative", "overrides"])


COUNTS = ["added", "changed", "overridden", "evicted"]


@dataclass
class Entry:
    """A remembered concept. Its key and its name are those that it came in under; surface and vector are the latest."""

    name: str
    surface: str
    polarity: str
    confidence: float
    created: int
    updated: int
    vector: np.ndarray | None
    overrides: int = 0


def fold_session(turns: list[int], events: list[tuple], config: MemoryConfig, kept: dict[str, Entry] | None = None) -> Iterator[tuple]:
    """The memory of one session after each turn, from `kept` on, which it changes.

    events are (turn, idx, concept, surface, confidence, vector, polarity), in any order: within a turn positives come first, each
    polarity by idx. A concept that is known, or (under semantic merging) near enough to a known one, strengthens that entry; if its
    polarity differs, it also turns it and counts as an override. After a turn with events, the max_concepts entries that stay are
    those updated last, of these the ones that came in last.
    Yields (turn, concept, name, surface, polarity, confidence, created, updated, position, overrides, added, changed, overridden, evicted,
    log of the turn's overrides); a state with an empty memory yields nothing.
    """
    kept = {} if kept is None else kept
    by_turn: dict[int, list[tuple]] = {}
    for e in events:
        by_turn.setdefault(e[0], []).append(e)
    for turn in sorted(turns):
        now = sorted(by_turn.get(turn, []), key=lambda e: (e[6] != "positive", e[1]))
        count, log = dict.fromkeys(COUNTS, 0), []
        for _, _, concept, surface, confidence, vector, polarity in now:
            key = concept if concept in kept else nearest(kept, vector, config)
            if key is None:
                kept[concept] = Entry(surface, surface, polarity, confidence, turn, turn, vector)
                count["added"] += 1
                continue
            old = kept[key]
            strength = max(old.confidence, confidence)
            if old.polarity != polarity:
                strength = min(1.0, strength + config.override_boost)
                log.append((key, old.polarity, polarity))
            turned = old.polarity != polarity
            kept[key] = Entry(old.name, surface, polarity, strength, old.created, turn, vector, old.overrides + turned)
            count["overridden" if turned else "changed"] += 1
        if now:
            place = {k: n for n, k in enumerate(kept)}
            stay = set(sorted(kept, key=lambda k: (kept[k].updated, place[k]), reverse=True)[: config.max_concepts])
            count["evicted"] = len(kept) - len(stay)
            for k in set(kept) - stay:
                del kept[k]
        for n, (k, e) in enumerate(kept.items()):
            yield turn, k, e.name, e.surface, e.polarity, e.confidence, e.created, e.updated, n, e.overrides, *count.values(), log


def nearest(kept: dict[str, Entry], vector: np.ndarray | None, config: MemoryConfig) -> str | None:
    """The entry most like the vector, the first of equals, if semantic merging is on and it is like enough."""
    if not config.semantic_merge or vector is None:
        return None
    like = [(float(np.dot(e.vector, vector)), -n, k) for n, (k, e) in enumerate(kept.items()) if e.vector is not None]
    best = max(like, default=(-2.0, 0, None))
    return best[2] if best[0] >= config.semantic_merge_threshold else None


ENTRY = "concept:string,name:string,surface:string,polarity:string,confidence:double,created:int,updated:int,overrides:int"
HELD = f"array<struct<{ENTRY},vector:array<double>>>"
LOG = "array<struct<concept:string,from:string,to:string>>"
#: A memory within a turn, and one after a turn.
WITHIN = f"struct<entries:{HELD},added:int,changed:int,overridden:int,matched:{LOG}>"
AFTER = f"struct<turn:int,entries:array<struct<{ENTRY}>>,added:int,changed:int,overridden:int,evicted:int,matched:{LOG}>"


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x computed once, however often use names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def place_of(entries: Column, e: Column, config: MemoryConfig) -> Column:
    """The number, from 1, of the entry that an event strengthens: the one of its concept, or, under semantic merging, the first of those most like it; else 0."""
    known = F.array_position(F.transform(entries, lambda x: x["concept"]), e["concept"]).cast("int")
    if not config.semantic_merge:
        return known
    like = F.array_max(F.transform(entries, lambda x, i: F.struct(S.dot(x["vector"], e["vector"]).alias("like"), (-i).alias("minus"))))
    return bound(like, lambda best: F.when(known > 0, known).when(best["like"] >= config.semantic_merge_threshold, 1 - best["minus"]).otherwise(0))


def told(within: Column, e: Column, turn: Column, config: MemoryConfig) -> Column:
    """The memory within a turn after one event more."""
    entries = within["entries"]

    def at(p: Column) -> Column:
        old = F.get(entries, p - 1)
        turned = old["polarity"] != e["polarity"]
        strength = F.greatest(old["confidence"], e["confidence"])
        fresh = F.struct(e["concept"], e["surface"], e["surface"], e["polarity"], e["confidence"], turn, turn, F.lit(0), e["vector"])
        stronger = F.struct(old["concept"], old["name"], e["surface"], e["polarity"], F.when(turned, F.least(F.lit(1.0), strength + config.override_boost)).otherwise(strength), old["created"], turn, old["overrides"] + turned.cast("int"), e["vector"])
        one = HELD.removeprefix("array<").removesuffix(">")
        after = F.when(p == 0, F.array_append(entries, fresh.cast(one))).otherwise(F.transform(entries, lambda x, i: F.when(i == p - 1, stronger.cast(one)).otherwise(x)))
        log = F.when((p > 0) & turned, F.array_append(within["matched"], F.struct(old["concept"].alias("concept"), old["polarity"].alias("from"), e["polarity"].alias("to")))).otherwise(within["matched"])
        count = lambda name, one_more: (within[name] + F.coalesce(one_more, F.lit(False)).cast("int"))
        return F.struct(after, count("added", p == 0), count("changed", (p > 0) & ~turned), count("overridden", (p > 0) & turned), log).cast(WITHIN)

    return bound(place_of(entries, e, config), at)


def folded_memory(states: DataFrame, events: DataFrame, vocabulary: DataFrame | None, config: MemoryConfig) -> DataFrame:
    """Memories where order matters: a binding cap, semantic merging, or polarities that override each other. By column functions.

    A session is one row: its turns in order, each with its events in order, and a fold over them whose state is the memory's entries.
    Within a turn positives come first, each polarity by idx. A concept that is known, or (under semantic merging) near enough to a
    known one, strengthens that entry; if its polarity differs, it also turns it and counts as an override. After a turn with events, the
    max_concepts entries that stay are those updated last, of these the ones that came in last. A state with an empty memory has no rows.
    """
    if "polarity" not in events.columns:
        events = events.withColumn("polarity", F.lit("negative"))
    if vocabulary is not None:
        vectors = vocabulary.select(F.col("text").alias("attribute"), S.unit(F.col("vector")).alias("vector"))
        events = events.join(vectors.hint("merge"), "attribute", "left").withColumn("vector", known(F.col("vector"), F.col("attribute")))
    else:
        events = events.withColumn("vector", F.lit(None).cast("array<double>"))
    event = F.struct((F.col("polarity") != "positive").alias("later"), "idx", "concept", F.col("attribute").alias("surface"), "polarity", "confidence", "vector")
    bundles = events.groupBy("session_id", "turn").agg(F.array_sort(F.collect_list(event)).alias("bundle"))
    turns = states.select("session_id", "turn").join(bundles.hint("merge"), ["session_id", "turn"], "left").withColumn("bundle", F.coalesce("bundle", F.array().cast(bundles.schema["bundle"].dataType)))
    sessions = turns.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", "bundle"))).alias("turns"))

    def stays(entries: Column) -> Column:
        """The entries that no max_concepts others come before: by their turn, then by their place."""
        ahead = lambda x, i: F.size(F.filter(entries, lambda y, j: (y["updated"] > x["updated"]) | ((y["updated"] == x["updated"]) & (j > i))))
        return F.when(F.size(entries) <= config.max_concepts, entries).otherwise(F.filter(entries, lambda x, i: ahead(x, i) < config.max_concepts))

    def step(acc: Column, t: Column) -> Column:
        begun = F.struct(acc["entries"], F.lit(0), F.lit(0), F.lit(0), F.array().cast(LOG)).cast(WITHIN)
        within = F.aggregate(t["bundle"], begun, lambda a, e: told(a, e, t["turn"], config))

        def done(w: Column) -> Column:
            kept = F.when(F.size(t["bundle"]) > 0, stays(w["entries"])).otherwise(w["entries"])
            told_ = lambda k: F.struct(t["turn"], F.transform(k, lambda x: F.struct(*(x[c.split(":")[0]] for c in ENTRY.split(",")))), w["added"], w["changed"], w["overridden"], F.size(w["entries"]) - F.size(k), w["matched"]).cast(AFTER)
            return bound(kept, lambda k: F.struct(k, F.array_append(acc["done"], told_(k))).cast(f"struct<entries:{HELD},done:array<{AFTER}>>"))

        return bound(within, done)

    start = F.struct(F.array().cast(HELD), F.array().cast(f"array<{AFTER}>")).cast(f"struct<entries:{HELD},done:array<{AFTER}>>")
    after = sessions.select("session_id", F.explode(F.aggregate("turns", start, step, lambda a: a["done"])).alias("t")).select("session_id", "t.*")
    rows = after.select("session_id", "turn", "added", "changed", "overridden", "evicted", "matched", F.posexplode("entries").alias("position", "x"))
    return rows.select("session_id", "turn", *(F.col(f"x.{c}") for c in ("concept", "name", "surface", "polarity", "confidence", "created", "updated")), "position", "x.overrides", *COUNTS, "matched")


def capped_memory(states: DataFrame, events: DataFrame, config: MemoryConfig) -> DataFrame:
    """memory() under a cap: sessions that never reach it take the closed form, the others the fold."""
    columns = ["session_id", "turn", "concept", "surface", "confidence", "created", "updated"]
    # a bundle may pass the cap for a moment, but a session with no more distinct concepts than the cap never evicts
    over = events.groupBy("session_id").agg(F.count_distinct("concept").alias("n")).where(F.col("n") > config.max_concepts).select("session_id").hint("merge")
    free = memory(states.join(over, "session_id", "left_anti"), events).select(columns)
    bound = folded_memory(states.join(over, "session_id", "left_semi"), events.join(over, "session_id", "left_semi"), None, config)
    return free.unionByName(bound.select(columns))


def exclusion_texts(states: DataFrame, mem: DataFrame) -> DataFrame:
    """Each state's text with its memory's concepts appended (in the order met, latest surfaces), and whether it has any."""
    concepts = mem.groupBy("session_id", "turn").agg(F.array_sort(F.collect_list(F.struct("first", "surface"))).alias("c")).select("session_id", "turn", F.col("c.surface").alias("concepts"))
    both = states.select("session_id", "turn", "query_text").join(concepts, ["session_id", "turn"], "left")
    return both.select("session_id", "turn", F.when(F.col("concepts").isNull(), F.trim("query_text")).otherwise(S.exclusion_text(F.col("query_text"), F.col("concepts"))).alias("text"), F.col("concepts").isNotNull().alias("has_memory"))


def text_queries(states: DataFrame, texts: DataFrame, encoded: DataFrame, only_memory: bool = True) -> DataFrame:
    """Query vectors from encoded texts; states without memory keep the host's vector, unless all are re-encoded."""
    v = encoded.select("text", F.col("vector").alias("encoded"))
    wanted = texts.where("has_memory") if only_memory else texts
    found = wanted.join(v.hint("merge"), "text", "left").select("session_id", "turn", known(F.col("encoded"), F.col("text")).alias("encoded"))
    both = states.join(found.hint("merge"), ["session_id", "turn"], "left")
    vector: Column = F.coalesce("encoded", "query_vector") if only_memory else F.col("encoded")
    return both.select("session_id", "turn", "target_index", S.unit(vector).alias("vector"))
