"""Operators on feeds: contract, reconciliation, features, models, evaluation, gate, monitoring, notes."""
