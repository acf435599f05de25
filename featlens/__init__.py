"""featlens: information-theoretic feature analysis as Spark DataFrame plans."""
