"""Runtime verification of trace data on Spark.

Spans come in as a DataFrame (batch or streaming), become start and end
events, are cut into event-time sessions per key, and are judged by monitors
whose state carries over from one session of a key to the next.
"""
