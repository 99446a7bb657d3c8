"""The search for quality rules goes on until nothing is left to find."""

import random

from scanspark.llm import quality_rules


def test_rare_kinds_of_junk_get_rules(spark):
    rnd, rows, labels = random.Random(5), [], []
    for i in range(6000):
        values = dict.fromkeys(quality_rules.MORE, 0.0) | {m: rnd.random() for m in ("q_upper", "q_digits", "q_marks")}
        bad = int(i % 4 == 0)
        if bad:  # 30 of 1500 bad rows, 2 %, are of another kind
            values["q_symbols" if i % 200 else "q_dup_lines"] = 5 + rnd.random()
        else:
            values |= {"q_symbols": rnd.random(), "q_dup_lines": rnd.random()}
        rows.append((i, 100, 0, *values.values()))
        labels.append((i, 1 - bad, 0))
    stats = spark.createDataFrame(rows, "doc_id long, n_words long, n_repeat_words long, " + ", ".join(f"{m} double" for m in quality_rules.MORE))
    rules = quality_rules.learn(stats, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).rules
    tested = {name for rule in rules for name, *_ in rule}
    assert {"symbols", "dup_lines"} <= tested
