"""Output shards of the mix: their counts, and documents in the order of their slots."""

from collections import Counter

from tessera.llm import mixing
from tessera.llm.common import Scratch

from tests.llm.test_operators import DOC

BLOCK = 8


def source(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(3 + i % 40)), "en", f"s{i % 3}", 0) for i in range(900)]
    return spark.createDataFrame(rows, DOC)


def test_shards_hold_their_slots(spark):
    _, plan = mixing.placed(spark, source(spark), Scratch(spark), BLOCK)
    draws = mixing.block_draws(plan).collect()
    assert sorted(d.slot for d in draws) == list(range(len(draws)))
    held = Counter(d.shard for d in draws)
    assert [held[k] for k in range(len(held))] == [mixing.SHARD] * (len(draws) // mixing.SHARD) + [len(draws) % mixing.SHARD]
    share = {p["rank"]: p.draws / p.all_draws for p in plan.collect()}
    by_source = Counter((d.shard, d["rank"]) for d in draws)
    for k in range(len(draws) // mixing.SHARD):  # without replacement: within five deviations of the share
        for r, p in share.items():
            assert abs(by_source[k, r] - mixing.SHARD * p) <= 5 * (mixing.SHARD * p * (1 - p)) ** 0.5


def test_each_run_lies_at_the_slot_of_its_first_block(spark):
    docs = source(spark)
    rows, plan = mixing.placed(spark, docs, Scratch(spark), BLOCK)
    slots = {}
    for d in mixing.block_draws(plan).collect():
        slots.setdefault((d["rank"], d.block), set()).add(d.slot)
    at = {r.doc_id: (r["rank"], r.begin) for r in rows.collect()}
    found = mixing.sharded_documents(spark, docs, BLOCK).collect()
    for r in found:
        rank, begin = at[r.row.doc_id]
        first = int(r.row.text.split()[0].split("w")[1])
        assert r.slot in slots[rank, (begin + first) // BLOCK] and r.shard == r.slot // mixing.SHARD
    taken = sum(r.taken for r in mixing.mix(spark, docs, BLOCK).collect())
    assert sum(len(r.row.text.split()) for r in found) == taken


def test_documents_come_in_mixed_order(spark):
    docs = source(spark)
    order = {}
    for r in mixing.sharded_documents(spark, docs, BLOCK).collect():
        order.setdefault((r.row.doc_id, r.row.text), []).append(r.slot)
    parts = mixing.mixed_documents(spark, docs, BLOCK).rdd.map(lambda r: (r.doc_id, r.text)).glom().collect()
    # Texts drawn once have one slot, which tells where they must lie.
    once = [[order[k][0] for k in part if len(order[k]) == 1] for part in parts]
    assert sum(map(len, once)) > 100 and all(p == sorted(p) for p in once)
    where = [{s // mixing.SHARD for s in p} for p in once]
    assert all(not (a & b) for i, a in enumerate(where) for b in where[:i])


def test_shard_counts_are_drawn_and_settle_what_is_taken(spark):
    """Counts per shard vary as a multinomial draw does; the slots' ordinals follow from them; totals are the targets."""
    docs = source(spark)
    _, plan = mixing.placed(spark, docs, Scratch(spark), BLOCK)
    sources = {p["rank"]: p for p in plan.collect()}
    total = sum(p.draws for p in sources.values())
    counts = {(r.shard, r["rank"]): r.slots for r in mixing.shard_counts(plan, Scratch(spark)).collect()}
    assert sum(map(len, counts.values())) == total
    whole = total // mixing.SHARD
    spread = [(len(counts.get((k, r), ())) - mixing.SHARD * p.draws / total) / (mixing.SHARD * p.draws / total * (1 - p.draws / total)) ** 0.5 for k in range(whole) for r, p in sources.items()]
    assert len(spread) >= 6 and any(spread) and max(map(abs, spread)) < 5
    draws = mixing.slot_draws(plan).collect()
    for r, p in sources.items():
        assert sorted(d.ordinal for d in draws if d["rank"] == r) == list(range(p.draws))
        # Own draws, in slot order, come before those that other sources had too many of.
        mine = sorted(s for (_, rank), slots in counts.items() if rank == r for s in slots)
        assert [d.ordinal for d in sorted(draws, key=lambda d: d.slot) if d["rank"] == r and d.slot in set(mine)] == list(range(min(p.draws, len(mine))))
    assert sorted(d.slot for d in draws) == list(range(total))


def test_first_shard(spark):
    docs = source(spark)
    rows, plan = mixing.placed(spark, docs, Scratch(spark), BLOCK)
    shard = {}
    for d in mixing.block_draws(plan).collect():
        shard[d["rank"], d.block] = min(d.shard, shard.get((d["rank"], d.block), d.shard))
    expected = {r.doc_id: min((shard[r["rank"], b] for b in range(r.begin // BLOCK, (r.begin + r.size - 1) // BLOCK + 1) if (r["rank"], b) in shard), default=None) for r in rows.collect()}
    assert {r.doc_id: r.first_shard for r in mixing.mix(spark, docs, BLOCK).collect()} == expected
