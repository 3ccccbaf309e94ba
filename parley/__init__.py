"""parley: conversation-risk analytics as Spark DataFrame jobs.

Raw dialogues -> speaker turns -> redacted text -> thread features -> quality
checks, profiles, stratified splits, exact distributed metrics, threshold
search, risk bands, and interpretable models fitted as grouped aggregations.
Every public function takes and returns DataFrames (or Columns); no function
pulls row data to the driver.
"""

__version__ = "0.1.0"
