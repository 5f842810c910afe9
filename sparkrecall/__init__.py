"""sparkrecall — retrieval, semantic-cache routing and QA evaluation as Spark jobs.

Every public function takes and returns DataFrames (or Columns). The work is
declared with the DataFrame API so Catalyst/AQE choose the physical plan; the
few Python-side pieces (dense block products, ROUGE-L, user generators) run as
Arrow-batched ``mapInPandas`` / ``applyInPandas`` inside Spark tasks.
"""

__version__ = "0.1.0"
