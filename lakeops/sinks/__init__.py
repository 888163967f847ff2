"""Writers. Each one can be run again after a lost executor or a crashed driver."""
