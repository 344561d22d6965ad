"""scanlake: building, checking and evaluating labelled image datasets on Spark."""
