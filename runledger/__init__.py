"""Analytics over logs of AI-agent runs, as Spark DataFrame operators."""
