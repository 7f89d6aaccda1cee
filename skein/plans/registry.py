"""All registered queries: name -> (query, SQL or None)."""

from skein.plans import agent, chunks, corpus, flows, indexed, ledger, ranked, tooling, views
from skein.plans.catalogue import CATALOGUE

REGISTRY = CATALOGUE | ranked.QUERIES | corpus.QUERIES | chunks.QUERIES | agent.QUERIES | ledger.QUERIES | flows.QUERIES | views.QUERIES | indexed.QUERIES | tooling.QUERIES
