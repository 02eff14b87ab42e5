"""The registered queries over the provided tables, and the SQL that checks them."""

from . import alignments, base, drivers, evaluation, files, more, parsers, records, sequences, sets, speech, streams, texts, units  # noqa: F401  importing registers

FLAGSHIP = "a1_confusion"
QUERIES, ORACLES = base.QUERIES, base.ORACLES
