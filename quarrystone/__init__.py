"""quarrystone: data curation, mining and evaluation operators as Spark plans."""
