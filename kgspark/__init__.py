"""kgspark: knowledge-graph analytics over document collections, on the DataFrame API."""
