"""Event-time market analytics and point-in-time text signals as Spark plans."""
