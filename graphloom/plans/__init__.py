"""Registered queries; importing this package registers them all."""

from graphloom.plans import ask, events, filters, joins, logs, memory, mentions, ranking, reports, retrieval, screening, streams, tables, texts  # noqa: F401
