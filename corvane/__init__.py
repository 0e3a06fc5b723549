"""corvane: code and corpus quality analytics as Spark dataflows."""
