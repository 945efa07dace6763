"""Find items that belong to a catalogue category but are missing from it, as Spark jobs."""
