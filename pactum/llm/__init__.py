"""Training-data operators: near-duplicate join, LM scoring, token counts,
quality classifier, PII, exact and approximate search, URL filter, BPE, packing.

Conventions shared by all operators here:

* only the columns an operator names are read; further columns, also ones whose
  names equal an output column, are ignored;
* a NULL text counts as the empty text unless the docstring says otherwise;
* intermediates that several jobs read are written as Parquet below the folder
  named by ``spark.checkpoint.dir`` (:func:`pactum.llm.common.stage`), so a lost
  executor costs its running tasks only.
"""
