"""labelflow: multi-label document classification analytics on Spark.

Everything is a DataFrame -> DataFrame function over long tables keyed by
(doc_id, code).  Sub-packages:

* ``sources``   readers / writers (documents, prediction contract, thresholds,
                policy, configs) and the fixture views over the test tables.
* ``functions`` column expressions (text zones, tokens, phrase parts, math).
* ``operators`` the analytical operators (labels, mining, matching, scoring,
                thresholds, metrics, calibration, orchestration, learning).
* ``plans``     end-to-end compositions and the query catalog.
* ``streaming`` incremental scoring of newly arriving documents.
"""

__all__ = ["session"]
