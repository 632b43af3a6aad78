"""DataFrame operators of the rule miner."""
