"""The registered queries and their SQL."""

from perievent.operators import coverage, curves, decoders, designs, drivers, extra, joins, machines, maps, metrics, models, more, retina, runs, series, stats

MODULES = (metrics, series, joins, stats, maps, models, more, extra, decoders, drivers, coverage, designs, machines, retina, curves, runs)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
