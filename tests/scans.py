"""Counts the scans of a table that a piece of code makes, and what it shuffles."""

from contextlib import contextmanager


@contextmanager
def scans(spark, rows):
    """Stages that read at least `rows` rows from storage or from the cache, each of which scans the whole table."""
    context = spark.sparkContext
    before = _stages(context)
    after = []
    yield lambda: sum(n >= rows for stage, n in after[0].items() if stage not in before)
    after.append(_stages(context))


@contextmanager
def shuffled(spark):
    """Bytes that a piece of code writes for its shuffles."""
    context = spark.sparkContext
    before = _stages(context, lambda s: s.shuffleWriteBytes())
    after = []
    yield lambda: sum(n for stage, n in after[0].items() if stage not in before)
    after.append(_stages(context, lambda s: s.shuffleWriteBytes()))


def _stages(context, figure=lambda s: s.inputRecords()):
    context._jsc.sc().listenerBus().waitUntilEmpty()
    quantiles = context._gateway.new_array(context._jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, quantiles, None)
    return {(s.stageId(), s.attemptId()): figure(s) for s in (stages.apply(i) for i in range(stages.size()))}
