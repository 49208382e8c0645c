"""runlens.sources"""
