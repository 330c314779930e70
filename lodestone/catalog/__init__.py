"""The registered queries of the engine's own operators, by theme; each stands beside the SQL that gives the same rows."""
