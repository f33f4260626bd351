"""recengine.sources"""
