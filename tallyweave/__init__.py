"""Analytics over corpora of language-model traces, as Spark DataFrame operators."""
