"""Decisions: conflicts with what was approved before, and batches decided in order."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import APPROVING, VERBS
from ..session import written
from .analytics import approvals


def conflicts(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """``candidates`` with how many approvals their category and their company hold already."""
    held = approvals(ledger)
    category = held.groupBy("category").agg(F.count_distinct("proposal_id").alias("in_category"))
    company = held.groupBy("company_id").agg(F.count_distinct("proposal_id").alias("of_company"))
    out = candidates.join(category, "category", "left").join(company, "company_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("in_category", "of_company")})


BLOCK = 500_000  # rows that one task decides in order, when rounds settle few
KEYS = ("category", "company_id")


def _behind(rows: DataFrame, standing: DataFrame) -> DataFrame:
    """``rows`` with ``behind``: whether an accepted row of their category or company comes before them."""
    late = F.lit(False)
    for key in KEYS:
        first = standing.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("order").alias(f"_by_{key}"))
        rows = rows.join(first, key, "left")
        late = late | F.coalesce(F.col(f"_by_{key}") < F.col("order"), F.lit(False))
    return rows.withColumn("behind", late).drop(*(f"_by_{key}" for key in KEYS))


def _in_order(rows: pd.DataFrame) -> pd.DataFrame:
    """Decides rows one after the other: a key that an accepted row holds is taken."""
    taken: dict[str, set] = {key: set() for key in KEYS}
    accepted = []
    for held in rows.sort_values(["seq", "proposal_id"], kind="stable")[list(KEYS)].itertuples(index=False):
        own = [(key, value) for key, value in zip(KEYS, held) if not pd.isna(value)]
        free = all(value not in taken[key] for key, value in own)
        accepted.append(free)
        if free:
            for key, value in own:
                taken[key].add(value)
    return rows.sort_values(["seq", "proposal_id"], kind="stable").assign(accepted=accepted)


def decide_batch(candidates: DataFrame, ledger: DataFrame, block: int = BLOCK) -> DataFrame:
    """(proposal_id, seq, decision, accepted, reason) for a batch in the order of ``seq``, then proposal_id.

    Candidates hold proposal_id, seq, decision, acknowledged, is_evaluated, category, company_id. Approving needs an evaluation, and is refused if category or company hold
    an approval, in the ledger or earlier in the batch, unless acknowledged. Each acceptance bears on later rows over two keys, so rows are settled in rounds: those behind an
    acceptance are refused, those that are the earliest open ones of both their keys accepted. Where a round settles less than a tenth of what is open (rows that wait for each other in
    long chains), the first ``block`` open rows are decided in order by one task: nothing that comes later can bear on them. A round writes one table, of the rows that were open.
    """
    rows = conflicts(candidates, ledger)
    approving = F.col("decision").isin(*APPROVING)
    taken = (F.col("in_category") > 0) | (F.col("of_company") > 0)
    reason = F.when(~F.col("decision").isin(*VERBS), "Unknown decision").when(approving & ~F.col("is_evaluated"), "Not evaluated").when(approving & taken & ~F.col("acknowledged"), "Conflicts with an earlier approval")
    settled = reason.isNotNull() | ~approving | F.col("acknowledged")
    columns = ("proposal_id", "seq", "decision", *KEYS, "order", "accepted", "reason")
    state = rows.select("proposal_id", "seq", "decision", *KEYS, F.struct("seq", "proposal_id").alias("order"), F.when(settled, reason.isNull()).alias("accepted"), reason.alias("reason"), approving.alias("_approving"))
    state = written(state, "batch")
    done, open_ = [state.where("accepted IS NOT NULL").select(*columns)], state.where("accepted IS NULL").select(*columns)
    standing, left = state.where("accepted AND _approving"), open_.count()
    slow = False
    while left:
        judged = _behind(open_, standing)
        refused = judged.where("behind").withColumn("accepted", F.lit(False)).withColumn("reason", F.lit("Conflicts with an earlier row of the batch")).select(*columns)
        free = judged.where("NOT behind").select(*columns)
        if slow:
            # rows beyond the block stay open; those in it come back decided
            first = free.select("proposal_id", "seq", "decision", *KEYS).orderBy("seq", "proposal_id").limit(block)
            schema = ", ".join(f"{c} {first.schema[c].dataType.simpleString()}" for c in first.columns) + ", accepted boolean"
            decided = written(first.groupBy(F.lit("block").alias("block")).applyInPandas(_in_order, schema), "block")
            marks = decided.select(F.struct("seq", "proposal_id").alias("order"), F.col("accepted").alias("_accepted"))
            free = free.join(marks, "order", "left").withColumn("accepted", F.col("_accepted"))
        else:
            for key in KEYS:
                free = free.join(free.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("order").alias(f"_first_{key}")), key, "left")
            earliest = F.lit(True)
            for key in KEYS:
                earliest = earliest & (F.coalesce(f"_first_{key}", "order") == F.col("order"))
            free = free.withColumn("accepted", F.when(earliest, True))
        why = F.when(~F.col("accepted"), "Conflicts with an earlier row of the batch").alias("reason")
        after = written(free.select(*columns[:-1], why).unionByName(refused), "batch")
        done.append(after.where("accepted IS NOT NULL"))
        open_, standing = after.where("accepted IS NULL"), after.where("accepted")
        before, left = left, open_.count()
        slow = (before - left) * 10 < before
    return reduce(DataFrame.unionByName, done).select("proposal_id", "seq", "decision", "accepted", "reason")


def freeze_dims(decisions: DataFrame, proposals: DataFrame) -> DataFrame:
    """Decisions with category and company as they are now where absent, and year and month."""
    now = proposals.select("proposal_id", F.col("category").alias("_category"), F.col("company_id").alias("_company"))
    out = decisions.join(now, "proposal_id", "left")
    out = out.withColumn("category", F.coalesce("category", "_category")).withColumn("company_id", F.coalesce("company_id", "_company"))
    return out.withColumn("decision_year", F.year("decided_at")).withColumn("decision_month", F.month("decided_at")).drop("_category", "_company")


def override_audit(decided: DataFrame) -> DataFrame:
    """Audit rows of accepted decisions: what was done and which conflicts were overridden."""
    kinds = F.array_compact(F.array(F.when(F.col("in_category") > 0, "category"), F.when(F.col("of_company") > 0, "company")))
    return decided.select("proposal_id", F.concat(F.lit("decision_"), F.col("decision")).alias("action"), F.to_json(F.struct(kinds.alias("overridden"))).alias("payload"))


def funding(candidates: DataFrame, selected: DataFrame, ledger: DataFrame) -> DataFrame:
    """A batch from a selection, decided: selected proposals for funding, which may conflict, the others unselected, which never do."""
    marks = selected.select("proposal_id").distinct().withColumn("_selected", F.lit(True))
    out = candidates.drop("decision").join(marks, "proposal_id", "left")
    return decide_batch(out.withColumn("decision", F.when(F.col("_selected"), "selected_for_funding").otherwise("unselected")).drop("_selected"), ledger)
