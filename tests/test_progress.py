from bytequarry.progress import progress


def test_progress_is_told(spark):
    lines = []
    slow = lambda it: [__import__("time").sleep(0.15) or b for b in it]
    with progress(spark, lines.append, 0.05):
        spark.range(0, 64, 1, 16).mapInArrow(slow, "id long").count()
    assert lines[-1].startswith("done") and any(x.startswith("stage") and x.endswith("/16") for x in lines)
