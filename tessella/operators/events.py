"""Event semantics in batch: screens visited, settled pointers, stalled transfers, access states, languages, ids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How far back a release looks and how still it must have been; a transfer's patience; tesseract's packs in their order.
LOOK_BACK_MS, SETTLED_PX = 90, 6.0
STALL_MS = 30_000
LANGUAGES = {"eng": 2.8, "fra": 0.7, "ita": 1.6, "spa": 2.0, "por": 1.3, "deu": 1.3, "kat": 1.0}
#: Access states: the dot, whether a folder is connected, and what its button offers.
ACCESS = {"unsupported": ("warn", None), "granted": ("ok", "pick"), "prompt": ("warn", "reconnect"), "denied": ("err", "pick"), "none": ("warn", "pick")}


def screens(events: DataFrame, session: str = "session", order: str = "seq") -> DataFrame:
    """For each event of a session what the screens do: (session, order, action, depth, screen).

    events: kind ('go' to `screen`, or 'pop' to `depth`). The first screen replaces, a new one is pushed over the present one, one
    that is on the stack is jumped to, the present one is drawn again. A jump's own pop event moves the depth; a pop outside the
    stack is held at its ends, and one that moves nothing does nothing. A fold over one session's events, in its own group."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        stack: list[str] = []
        at, out = -1, []
        for r in rows.sort_values(order).itertuples():
            if r.kind == "pop":
                to = min(max(int(r.depth), 0), len(stack) - 1)
                if not stack or to == at:
                    out.append((getattr(r, order), "none", at, stack[at] if stack else None))
                else:
                    at = to
                    out.append((getattr(r, order), "show", at, stack[at]))
            elif r.screen in stack:
                place = stack.index(r.screen)
                out.append((getattr(r, order), "render" if place == at else "jump", place, r.screen))
            else:
                stack = [*stack[: at + 1], r.screen]
                at = len(stack) - 1
                out.append((getattr(r, order), "push" if at else "replace", at, r.screen))
        done = pd.DataFrame(out, columns=[order, "action", "depth", "screen"])
        done.insert(0, session, rows[session].iloc[0])
        return done

    kinds = dict(events.dtypes)
    return events.select(session, order, "kind", "screen", F.coalesce("depth", F.lit(0)).alias("depth")).groupBy(session).applyInPandas(fold, f"{session} {kinds[session]}, {order} {kinds[order]}, action string, depth int, screen string")


def release_points(moves: DataFrame, key: str = "drag") -> DataFrame:
    """Where each drag ends: (key, x, y, corrected). moves: t in ms, x, y; the last is the release.

    If the pointer was where it had been LOOK_BACK_MS before the release and stayed within SETTLED_PX of it since, that place."""
    w = Window.partitionBy(key)
    last = moves.withColumn("end", F.max("t").over(w))
    anchor = last.where(F.col("end") - F.col("t") >= LOOK_BACK_MS).groupBy(key).agg(F.max(F.struct("t", "x", "y")).alias("a"))
    final = last.groupBy(key).agg(F.max(F.struct("t", "x", "y")).alias("f"))
    near = last.join(anchor, key).where(F.col("t") >= F.col("a.t")).groupBy(key, "a").agg((F.max(F.hypot(F.col("x") - F.col("a.x"), F.col("y") - F.col("a.y"))) <= SETTLED_PX).alias("still"))
    out = final.join(near, key, "left")
    still = F.coalesce("still", F.lit(False))
    return out.select(key, F.when(still, F.col("a.x")).otherwise(F.col("f.x")).alias("x"), F.when(still, F.col("a.y")).otherwise(F.col("f.y")).alias("y"), still.alias("corrected"))


def stalled(chunks: DataFrame, key: str = "file", ts: str = "t", now: Column | None = None, patience: int = STALL_MS) -> DataFrame:
    """(key, n_bytes, stalled): a transfer whose chunks (t in ms, size, done) came more than `patience` apart, or that waits so long by now."""
    gap = F.col(ts) - F.lag(ts).over(Window.partitionBy(key).orderBy(ts))
    rows = chunks.withColumn("gap", gap).groupBy(key).agg(F.sum("size").alias("n_bytes"), F.max("gap").alias("gap"), F.max(ts).alias("last"), F.bool_or("done").alias("done"))
    waits = F.lit(False) if now is None else (now - F.col("last") > patience) & ~F.col("done")
    return rows.select(key, "n_bytes", ((F.coalesce("gap", F.lit(0)) > patience) | waits).alias("stalled"))


def access(rows: DataFrame, state: str = "state") -> DataFrame:
    """rows with dot and button; a state that isn't known is as none."""
    known = F.when(F.col(state).isin(*ACCESS), F.col(state)).otherwise("none")
    of = lambda i: F.create_map(*[x for s, v in ACCESS.items() for x in (F.lit(s), F.lit(v[i]).cast("string"))])[known]
    return rows.withColumns({"dot": of(0), "button": of(1)})


def active_languages(chosen: Column, most: int = 3) -> Column:
    """The known ones, at most three, else the default."""
    known = F.slice(F.filter(chosen, lambda c: c.isin(*LANGUAGES)), 1, most)
    return F.when(F.size(F.coalesce(known, F.array().cast("array<string>"))) > 0, known).otherwise(F.array(F.lit("eng"), F.lit("fra")))


def pack_name(codes: Column) -> Column:
    """The codes in the order of the packs, joined by +; unknown ones first, as they came."""
    order = F.array(*map(F.lit, LANGUAGES))
    placed = F.transform(codes, lambda c, i: F.struct(F.array_position(order, c).alias("p"), i.alias("i"), c.alias("c")))
    return F.array_join(F.transform(F.sort_array(placed), lambda x: x["c"]), "+")


def pack_megabytes(codes: Column) -> Column:
    sizes = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(mb).alias("mb")) for c, mb in LANGUAGES.items()])
    return F.aggregate(F.filter(sizes, lambda s: F.array_contains(codes, s["c"])), F.lit(0.0), lambda a, s: a + s["mb"])


def new_id(ms: Column, prefix: str = "d") -> Column:
    """Prefix, the time in base 36 and four random characters: in order of time, and unique within a millisecond for practical purposes."""
    return F.concat(F.lit(prefix), F.lower(F.conv(ms.cast("string"), 10, 36)), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 4))


def folder_settings(notes: Column, attachments: Column, default_notes: str, default_attachments: str) -> Column:
    """Both folders cleaned, the default for one that is blank."""
    from tessella.functions.text import folder

    of = lambda x, d: F.when(F.coalesce(folder(x), F.lit("")) != "", folder(x)).otherwise(F.lit(d))
    return F.struct(of(notes, default_notes).alias("notes"), of(attachments, default_attachments).alias("attachments"))
