"""barkgraph: relational and sequential operators for audio-visual tracking tables, as Spark plans."""
