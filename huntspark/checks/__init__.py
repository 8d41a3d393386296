"""One check per operator: a Spark query and, where SQL can say it, its twin."""
from . import joins, normalize, predicates, questions, rollups, rules, sources, windows

ALL_CHECKS = [questions, sources, normalize, predicates, rules, joins, rollups, windows]
