"""Trees whose chunks are moved once: equal to SQL-like definitions, odd places too."""

from quern.operators import chunks, tree


def test_levels_of_odd_places(spark):
    rows = [("a", i, i * 10, f"w{i} w{i} common z") for i in range(31)] + [("b", 0, 0, "one")] + [("c", i, i, f"x{i}") for i in (0, 3, 3, 7, 26)]
    df = spark.createDataFrame(rows, "doc_id string, at long, start_offset long, content string")
    made = {(r["doc_id"], r["level"], r["at"]): r for r in tree.build(df).collect() if r["level"]}
    want, level = {}, {}
    for d, at, start, content in sorted(rows):
        level.setdefault((d, at), []).append((content, start, start + len(content)))
    now, n = level, 1
    while any(at for _, at in now):
        up = {}
        for (d, at), held in sorted(now.items()):
            if max(a for e, a in now if e == d):
                up.setdefault((d, at // 5), []).append(held if n > 1 else held)
        now = {}
        for (d, at), children in up.items():
            flat = [x for c in children for x in c]
            want[d, n, at] = (len(flat) if n == 1 else len(children), "\n\n".join(x for x, _, _ in flat), min(s for _, s, _ in flat), max(e for _, _, e in flat))
            now[d, at] = flat
        n += 1
    assert {k: (r["children"], r["content"], r["start"], r["end"]) for k, r in made.items()} == want
    assert {tuple(r) for r in tree.shape(df).where("level > 0").collect()} == set(made)


def test_chunks_are_moved_once(spark):
    docs = spark.createDataFrame([(1, "ab cd " * 900)], "doc_id long, text string")
    plan = tree.build(chunks.fixed(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "Window" not in plan  # one, and its copy in the plan's text
