"""Status sequences against a walk over each intake, whatever the ranges are."""

import random

import pytest

from narralake.operators import sequence as sq

LOG = "intake_id bigint, seq bigint, status string"


def walk(rows):
    """intake -> (records, changes, illegal, first illegal seq, final status), one record after another."""
    out = {}
    for intake in {r[0] for r in rows}:
        own = sorted((r[1], sq.STATES.index(r[2]) if r[2] in sq.STATES else -1, r[2]) for r in rows if r[0] == intake and r[1] is not None)
        if not own:
            continue
        before, changes, bad = None, 0, []
        for i, (seq, code, status) in enumerate(own):
            name = status if code >= 0 else None
            if i == 0:
                if name != "generating":
                    bad.append(seq)
            elif name != before:
                changes += 1
                if name not in sq.MAY_FOLLOW.get(before, ()):
                    bad.append(seq)
            before = name
        out[intake] = (len(own), changes, len(bad), bad[0] if bad else None, before)
    return out


def checked(df, partitions=None):
    return {
        r.intake_id: (r.records, r.changes, r.illegal, r.first_illegal_seq, r.final_status)
        for r in sq.sequence_check(df, partitions).collect()
    }


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_random_logs(spark, partitions):
    r = random.Random(partitions)
    rows = [
        (r.choice([1, 1, 1, 2, 3, None]), s, r.choice([*sq.STATES, "generating", "merging", None, "odd"]))
        for s in r.sample(range(5000), 600)
    ]
    rows += [(4, None, "generating"), (5, 1, "failed")]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, LOG).repartition(4)
    assert checked(df, partitions) == walk(rows)
    assert sq.sequence_check(df.limit(0)).count() == 0


def test_a_legal_run_and_its_restart(spark):
    steps = "generating waiting_quota generating merging failed generating cancelling cancelled generating merging completed".split()
    rows = [(7, 10 * i, s) for i, s in enumerate(steps)]
    assert checked(spark.createDataFrame(rows, LOG), 4) == {7: (11, 10, 0, None, "completed")}


def test_hot_intake_with_numbers_far_apart_has_few_stretches(spark):
    """A third of all records in one intake, its numbers 2**20 apart."""
    r = random.Random(5)
    rows = [(0, i << 20, r.choice(sq.STATES)) for i in range(3000)]
    rows += [(1 + i % 40, i, r.choice(sq.STATES)) for i in range(6000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, LOG).repartition(6)
    found = sq.stretches(df, 12).collect()
    assert len(found) <= 12 + 41
    assert max(s.records for s in found) <= 3 * len(rows) // 12
    assert checked(df, 12) == walk(rows)
