"""planweave: document analytics for drawing sets, expressed as Spark plans."""
